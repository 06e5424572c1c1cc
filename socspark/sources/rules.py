"""Rule files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from socspark.operators.detect import SigmaRule, UnsupportedRule, compile_sigma


def load_sigma_rules(spark: SparkSession, paths: list[str]) -> tuple[list[SigmaRule], list[dict[str, str]]]:
    """SRC-14: the rules of YAML files below ``paths``, in order of file name, and what was skipped with the reason.

    Of rules that share an id the first stays. Rules are metadata, thousands at
    most, and become Column predicates on the driver.
    """
    import yaml

    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{yml,yaml}").text(paths, wholetext=True)
    rules: dict[str, SigmaRule] = {}
    skipped: list[dict[str, str]] = []
    for row in sorted(files.select("_metadata.file_path", "value").collect()):
        skip = lambda reason, path=row["file_path"]: skipped.append({"file": path, "reason": str(reason).split("\n")[0]})
        try:
            documents = [d for d in yaml.safe_load_all(row["value"]) if d]
        except yaml.YAMLError as e:
            skip(f"unreadable: {e}")
            continue
        for document in documents:
            if isinstance(document, dict) and document.get("action") == "global":
                skip("global document")
                break
            try:
                rule = compile_sigma(document, row["file_path"])
            except (UnsupportedRule, ValueError, TypeError, AttributeError) as e:
                skip(e)
                continue
            rules.setdefault(rule.id, rule)
    return list(rules.values()), skipped
