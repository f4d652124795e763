"""Secret scans: a trigram index names the documents that a rule can match, expressions verify them.

Every step is a DataFrame expression. Postings hold the trigrams that the rules' queries mention; a
rule's clauses are intersected by counting postings, and only candidates are scanned for it. Rules
without mandatory trigrams scan every document.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortlake.llm.common import table
from cohortlake.llm.line_dedup import ROW, identified
from cohortlake.llm.trigrams import trigram_query


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches are kept if ``value`` (a group) has ``least`` code points."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 0
    base: bool = False


# The base rules and the order of their kinds.
BASE_RULES = (
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        value=2,
        least=6,
        base=True,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=20, base=True),
    # Runs of hex digits are maximal, so the least length may stand in the expression.
    Rule("hex", r"[0-9a-f]{24,}", least=24, base=True),
)
# Publicly documented shapes of further credentials.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment_key", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("url_password", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{3,64}@"),
)
RULES = (*BASE_RULES, *MORE_RULES)


def clause_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """(trigram, rule, clause, needed): the rules' Boolean queries as rows, as many as the rules ask."""
    rows = []
    for i, rule in enumerate(rules):
        for k, clause in enumerate(sorted(map(sorted, trigram_query(rule.pattern) or ()))):
            rows.extend((t, i, k, len(clause)) for t in clause)
    return spark.createDataFrame(rows, "trigram string, rule int, clause int, needed int")


def postings(docs: DataFrame, trigrams: Sequence[str]) -> DataFrame:
    """(trigram, doc_id, text_hash) of the inverted index over the given trigrams, case folded."""
    folded = F.lower("text")
    held = [F.when(F.contains(folded, F.lit(t)), F.lit(t)) for t in trigrams]
    found = F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")
    return docs.select(F.explode(found).alias("trigram"), *ROW)


def candidates(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(doc_id, text_hash, rules): which rules may match each document that any rule may match.

    A posting is one row, so a trigram that every document holds is no list anywhere; counting per
    document and clause is partial, and a document's postings arise in one task.
    """
    clauses = clause_table(docs.sparkSession, rules)
    wanted = sorted({t for rule in rules for clause in trigram_query(rule.pattern) or () for t in clause})
    hits = (
        postings(docs, wanted)
        .join(F.broadcast(clauses), "trigram")  # as many rows as the rules have trigrams
        .groupBy(*ROW, "rule", "clause")
        .agg(F.count_distinct("trigram").alias("held"), F.max("needed").alias("needed"))
        .filter("held = needed")
        .select(*ROW, "rule")
    )
    full = [i for i, rule in enumerate(rules) if trigram_query(rule.pattern) is None]
    scanned = F.array_compact(F.array(*[F.when(F.rlike("text", F.lit(rules[i].pattern)), F.lit(i)) for i in full]))
    if full:
        hits = hits.unionByName(docs.select(*ROW, F.explode(scanned).alias("rule")))
    return hits.groupBy(*ROW).agg(F.collect_set("rule").alias("rules"))


def found_by(rule: Rule, number: int) -> Column:
    """The matches of a rule in ``text`` with the lengths needed to place them.

    Splitting at the matches gives what stands before each; running totals of both lengths are the
    spans, leftmost and not overlapping.
    """
    pattern = F.lit(rule.pattern)
    lengths = F.transform(F.regexp_extract_all("text", pattern, F.lit(0)), F.char_length)
    values = F.transform(F.regexp_extract_all("text", pattern, F.lit(rule.value)), F.char_length)
    gaps = F.transform(F.split("text", rule.pattern, -1), F.char_length)
    return F.transform(
        F.filter(F.arrays_zip(lengths.alias("n"), values.alias("v"), gaps.alias("gap")), lambda m: m["n"].isNotNull()),
        lambda m, i: F.struct(F.lit(number).alias("rule"), i.alias("i"), m["gap"].alias("gap"), m["n"].alias("n"), (m["v"] >= rule.least).alias("good")),
    )


def find_secrets(
    docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", ident: str = "doc_id"
) -> DataFrame:
    """doc_id and spans of each row of ``docs``: an array of (start, rule, kind, end), sorted.

    Starts and ends count code points, ends are exclusive. Matches of one rule never overlap; those
    of several rules may. Null and empty texts, and texts without a match, give an empty array.
    Repeated rows give the same spans. An empty table gives no rows.
    """
    whole = identified(docs, text, ident)
    chosen = candidates(whole, rules).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "rules")
    same = whole["doc_id"].eqNullSafe(chosen["__id"]) & (whole["text_hash"] == chosen["__hash"])
    # Rows with the same identifier and text are one document from here on.
    verified = whole.join(chosen, same).groupBy(*ROW).agg(F.first("text").alias("text"), F.first("rules").alias("rules"))
    none = F.array().cast("array<struct<rule:int,i:int,gap:int,n:int,good:boolean>>")
    each = [F.when(F.array_contains("rules", i), found_by(rule, i)).otherwise(none) for i, rule in enumerate(rules)]
    matches = verified.select(*ROW, F.explode(F.concat(*each)).alias("m")).select(*ROW, "m.*")
    before = Window.partitionBy(*ROW, "rule").orderBy("i")
    end = F.sum(F.col("gap") + F.col("n")).over(before)
    kind = F.element_at(F.array(*[F.lit(r.kind) for r in rules]), F.col("rule") + 1)
    spans = (
        matches.withColumn("end", end)
        .filter("good")
        .groupBy(*ROW)
        .agg(
            F.array_sort(
                F.collect_list(F.struct((F.col("end") - F.col("n")).alias("start"), "rule", kind.alias("kind"), "end"))
            ).alias("spans")
        )
        .select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "spans")
    )
    ids = whole.select(*ROW)
    same = ids["doc_id"].eqNullSafe(spans["__id"]) & (ids["text_hash"] == spans["__hash"])
    return ids.join(spans, same, "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)).alias("spans")
    )


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts, checksum and places of the secrets of every document."""
    found = find_secrets(table(spark, folder, "documents"))

    def count(rule: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["rule"] == rule)).cast("long")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    base = F.filter("spans", lambda s: s["rule"] < len(BASE_RULES))
    return found.select(
        "doc_id", *counts, F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans")
    )


def _sql_rule(number: int, rule: Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""
  SELECT doc_id, {number} AS rule, '{rule.kind}' AS kind, {rule.least} AS least,
    string_split_regex(text, {pattern}) AS gaps, regexp_extract_all(text, {pattern}) AS found,
    regexp_extract_all(text, {pattern}, {rule.value}) AS vals
  FROM whole WHERE regexp_matches(text, {pattern})"""


OP6_SQL = f"""
WITH whole AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({" UNION ALL ".join(_sql_rule(i, r) for i, r in enumerate(RULES))}),
rows AS (
  SELECT doc_id, rule, kind, least, unnest(found) AS f, unnest(vals) AS v, unnest(gaps[:len(found)]) AS g,
    generate_subscripts(found, 1) AS i FROM matches),
placed AS (
  SELECT *, CAST(sum(length(g) + length(f)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS BIGINT) AS e FROM rows),
spans AS (
  SELECT doc_id, rule, kind, e - length(f) AS s, concat(kind, ':', e - length(f), ':', e) AS span
  FROM placed WHERE length(v) >= least)
SELECT w.doc_id, count(*) FILTER (WHERE rule = 0) AS n_assign, count(*) FILTER (WHERE rule = 1) AS n_access,
  count(*) FILTER (WHERE rule = 2) AS n_hex,
  sha256(coalesce(string_agg(span, ',' ORDER BY s, rule) FILTER (WHERE rule < {len(BASE_RULES)}), '')) AS base_sha256,
  coalesce(string_agg(span, ',' ORDER BY s, rule), '') AS spans
FROM whole w LEFT JOIN spans USING (doc_id) GROUP BY w.doc_id
"""
