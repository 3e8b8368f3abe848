"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every historical version of a document is addressed by its content (a blob). The ledger says which pairs of blob and
rule version have been scanned and what was found. A scan takes only pairs that the ledger lacks, once per blob however
many paths hold it, and joins findings back to all paths.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import stage


def either_case(pattern: str) -> str:
    """Letters outside brackets and escapes in either case, ASCII only (a flag would fold other letters too)."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", pattern)


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``value`` is what must have ``least`` characters: a group of the pattern, 0 for all of it."""

    kind: str
    version: int
    pattern: str
    least: int
    value: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


ASSIGN_KEYS = either_case("password|passwd|secret|token|api_?key")
ASSIGN_PATTERN = f"""({ASSIGN_KEYS})["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: Greedy runs of one class, so a least length can stand in the pattern: a shorter run never hides a longer one.
RULES = (
    Rule("assign", 1, ASSIGN_PATTERN, 12, value=2),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", 18),
    Rule("hex", 1, "[0-9a-f]{16,}", 16),
)

LEDGER_SCHEMA = "blob string, rule string, kind int, starts array<int>, ends array<int>"


def versions(docs: DataFrame) -> DataFrame:
    """``path, text, blob`` of each row; a null text is an empty blob."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").alias("path"), text.alias("text"), F.sha2(text, 256).alias("blob"))


def unseen(paths: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """``blob, text, due``: each blob with a rule version that the ledger lacks, and those rule versions."""
    heads = paths.groupBy("blob").agg(F.min("path").alias("head"))
    every = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        heads = heads.withColumn("due", every)
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        none = F.array().cast("array<string>")
        heads = heads.join(seen, "blob", "left").withColumn("due", F.array_except(every, F.coalesce("seen", none)))
        heads = heads.filter(F.size("due") > 0).drop("seen")
    heads = heads.withColumnRenamed("blob", "head_blob")
    same = (F.col("blob") == F.col("head_blob")) & F.col("path").eqNullSafe(F.col("head"))
    return paths.join(heads, same).select("blob", "text", "due")


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Ledger rows of the due rule versions of each blob, also where nothing is found.

    A text is its gaps (``split``) and matches (``regexp_extract_all``) in turn, both leftmost and without overlap; the
    running sum of their lengths gives positions in code points. A match whose value is too short is dropped
    afterwards, for it still hides what it covers.
    """

    def one(number: int, rule: Rule) -> Column:
        pattern = F.lit(rule.pattern)
        found = F.regexp_extract_all("text", pattern, F.lit(0))
        return F.when(F.array_contains("due", rule.key), found).alias(f"m{number}")

    matched = blobs.select("blob", "text", "due", *[one(i, r) for i, r in enumerate(rules)])

    def parts(number: int, rule: Rule) -> Column:
        found = F.col(f"m{number}")
        gaps = F.split(F.col("text"), rule.pattern, -1)
        value = found if not rule.value else F.transform(found, lambda m: F.regexp_extract(m, rule.pattern, rule.value))
        lengths = F.arrays_zip(
            F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("gap"),
            F.transform(found, F.length).alias("own"),
            F.transform(value, F.length).alias("value"),
        )
        nothing = F.array().cast("array<struct<gap:int,own:int,value:int>>")
        lengths = F.when(F.size(found) > 0, lengths).otherwise(nothing)
        return F.struct(F.lit(rule.key).alias("rule"), F.lit(number).alias("kind"), F.lit(rule.least).alias("least"),
                        lengths.alias("parts"))

    each = matched.select("blob", "due", F.array(*[parts(i, r) for i, r in enumerate(rules)]).alias("each"))
    each = each.select("blob", F.explode(F.filter("each", lambda x: F.array_contains("due", x["rule"]))).alias("x"))
    each = each.select("blob", "x.*")
    nothing = F.array().cast("array<int>")
    done = each.filter(F.size("parts") == 0).select("blob", "rule", "kind", nothing.alias("starts"), nothing.alias("ends"))

    rows = each.filter(F.size("parts") > 0).select("blob", "rule", "kind", "least", F.posexplode("parts").alias("nth", "p"))
    upto = Window.partitionBy("blob", "rule").orderBy("nth")
    rows = rows.distinct().withColumn("end", F.sum(F.col("p.gap") + F.col("p.own")).over(upto).cast("int"))
    good = F.col("p.value") >= F.col("least")
    spans = rows.groupBy("blob", "rule", "kind").agg(
        F.array_sort(F.collect_list(F.when(good, F.struct((F.col("end") - F.col("p.own")).alias("s"), F.col("end").alias("e"))))).alias("x")
    )
    return done.unionByName(spans.select("blob", "rule", "kind", F.col("x.s").alias("starts"), F.col("x.e").alias("ends")))


def update_ledger(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> tuple[DataFrame, DataFrame]:
    """The paths of ``docs`` with their blobs, and the ledger with all they need: old rows and newly scanned ones."""
    paths = versions(docs)
    fresh = scan(unseen(paths, ledger, rules), rules).select("blob", "rule", "kind", "starts", "ends")
    fresh = stage(fresh, "secret-ledger")
    return paths.select("path", "blob"), fresh if ledger is None else ledger.unionByName(fresh)


def findings_by_blob(ledger: DataFrame, rules=RULES) -> DataFrame:
    """``blob, spans``: all findings of the present rule versions, by start, then kind. Blobs without any are absent.

    A table of its own: its size says how it meets the paths, and a join that reads it as it lies can be split where one
    blob has very many paths, which Spark does not do above an aggregate.
    """
    keys = [r.key for r in rules]
    found = ledger.filter(F.col("rule").isin(keys) & (F.size("starts") > 0)).dropDuplicates(["blob", "rule"])
    span = F.struct(F.col("z.starts").alias("start"), F.col("kind"), F.col("z.ends").alias("end"))
    found = found.select("blob", "kind", F.explode(F.arrays_zip("starts", "ends")).alias("z")).select("blob", span.alias("s"))
    return stage(found.groupBy("blob").agg(F.array_sort(F.collect_list("s")).alias("spans")), "secret-findings")


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``doc_id, spans`` of every row of ``docs``: array of (start, kind, end), code points, end exclusive.

    Null and empty texts have no spans; rows that repeat a path or a text get the findings of their blob; an empty
    table gives no rows; very long texts are scanned whole.
    """
    paths, known = update_ledger(docs, ledger, rules)
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return paths.join(findings_by_blob(known, rules), "blob", "left").select(
        F.col("path").alias("doc_id"), F.coalesce("spans", nothing).alias("spans")
    )


def count_kind(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def describe(spans: Column, rules=RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    shown = F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"].cast("string"), s["end"].cast("string")))
    return F.concat_ws(",", shown)


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with every finding replaced by its kind in brackets; overlapping findings share the first one's mark."""
    spans = findings_by_blob(update_ledger(docs, None, rules)[1], rules)
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    rows = docs.select(F.struct("*").alias("row"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob"))
    rows = rows.join(spans, "blob", "left").select("row", "spans")
    text, ends = F.col("row")["text"], F.transform("spans", lambda s: s["end"])

    def piece(s, i):
        upto = F.coalesce(F.array_max(F.slice(ends, 1, i)), F.lit(0))
        mark = F.concat(text.substr(upto + 1, s["start"] - upto), F.lit("["), kinds[s["kind"]], F.lit("]"))
        return F.when(s["start"] < upto, "").otherwise(mark)

    tail = text.substr(F.array_max(ends) + 1, F.length(text))
    clean = F.concat(F.array_join(F.transform("spans", piece), ""), tail)
    row = rows.select("row", F.when(F.col("spans").isNotNull(), clean).otherwise(text).alias("clean"))
    changed = {"text": F.col("clean"), "n_chars": F.length("clean").cast("bigint")}
    changed = {c: F.when(text.isNotNull(), changed[c]) if c == "text" else F.when(F.col("clean") != text, changed[c]).otherwise(F.col("row")[c]) for c in docs.columns if c in changed}
    return row.select(*[changed.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
