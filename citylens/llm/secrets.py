"""Secret scans with an incremental blob ledger.

Every text is a blob addressed by the SHA-256 of its content.  The ledger is
a Parquet table of (blob, rule, version, spans): which rule version has
looked at which blob, and what it found.  A scan looks only at the pairs the
ledger does not have yet, appends them, and joins the findings back to every
row that holds the blob.  All of it is DataFrame operations.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citylens.llm._tables import documents, fresh, text_of
from citylens.session import scratch_path

LEDGER_SCHEMA = "blob binary, rule string, version int, spans array<struct<start:int,end:int>>"


@dataclass(frozen=True)
class Rule:
    """A pattern (Java regular expression); a match counts if ``group`` has at least ``least`` characters.

    Matches are taken leftmost and without overlap before the short ones are
    dropped.  A higher ``version`` makes the rule run again over every blob.
    """

    name: str
    pattern: str
    group: int
    least: int
    version: int = 1


#: Kinds in the order of the contract, then those this scanner adds.
ASSIGN = Rule(
    "assign",
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    2,
    6,
)
ACCESS = Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20)
HEX = Rule("hex", r"([0-9a-f]+)", 1, 24)
PEM = Rule("pem", r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1)
JWT = Rule("jwt", r"(eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+)", 1, 20)
BASE_RULES = (ASSIGN, ACCESS, HEX)
RULES = (*BASE_RULES, PEM, JWT)

#: For rules whose pattern is one maximal run, the shortest run that counts can be asked for in the pattern itself:
#: a shorter run has no match in it either way, and nothing is read of the many runs that are too short.
_SCAN_PATTERNS = {"access": r"(AKIA[A-Z0-9]{16,}+)", "hex": r"((?<![0-9a-f])[0-9a-f]{24,}+)"}


_SPANS = "array<struct<start:int,end:int>>"
#: Matches walked at a time; longer lists are walked in chunks and put together.
_CHUNK = 512


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), use)[0]


def find_spans(text: Column, rule: Rule) -> Column:
    """``array<struct<start, end>>`` in code points of the rule's matches in a text column.

    The gaps between matches (``split``) and the matches themselves
    (``regexp_extract_all``) alternate, so running sums of their lengths are
    the positions.
    """
    pattern = _SCAN_PATTERNS.get(rule.name, rule.pattern) if rule in RULES else rule.pattern
    lengths = lambda strings: F.transform(strings, F.length)
    gaps = lengths(F.split(text, pattern, -1))
    whole = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    part = lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)))
    both = F.zip_with(whole, part, lambda w, p: F.struct(w.alias("whole"), p.alias("part")))
    # the last gap has no match after it
    steps = F.zip_with(gaps, both, lambda g, m: F.struct(g.alias("gap"), m["whole"].alias("whole"), m["part"].alias("part")))

    def walk(chunk: Column) -> Column:
        """End and spans of a chunk of steps, from position 0."""

        def step(state: Column, x: Column) -> Column:
            start = state["at"] + x["gap"]
            end = start + F.coalesce(x["whole"], F.lit(0))
            span = F.array(F.struct(start.alias("start"), end.alias("end")))
            spans = F.when(x["part"] >= rule.least, F.concat(state["spans"], span)).otherwise(state["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        return F.aggregate(chunk, F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")), step)

    def join(state: Column, chunk: Column) -> Column:
        moved = F.transform(
            chunk["spans"],
            lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end")),
        )
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["spans"], moved).alias("spans"))

    def all_spans(steps: Column) -> Column:
        chunks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _CHUNK).cast("int")),
            lambda c: walk(F.slice(steps, c * _CHUNK + 1, _CHUNK)),
        )
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans"))
        return F.aggregate(chunks, start, join, lambda s: s["spans"])

    return F.when(F.regexp_like(text, F.lit(pattern)), _let(steps, all_spans)).otherwise(F.array().cast(_SPANS))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger at ``path``; an empty one if nothing was written there yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    columns = ("CAST(NULL AS BINARY) blob", "'' rule", "0 version", f"CAST(NULL AS {_SPANS}) spans")
    return spark.range(0).selectExpr(*columns)


def _among(rules: Sequence[Rule]) -> Column:
    """Whether a ledger row is of one of these rules in its version."""
    return reduce(or_, [(F.col("rule") == r.name) & (F.col("version") == r.version) for r in rules])


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(df: DataFrame, ledger_path: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Bring the ledger up to date with the texts of ``df`` and return it.

    Blobs are distinct before they are looked at, partly so in every task, so
    many copies of one text cost one row per task.  Only unseen (blob, rule,
    version) triples are scanned; what is found, and that nothing was found,
    is appended in one write.  NULL text is the empty blob; an empty table adds
    nothing to the ledger.
    """
    spark = df.sparkSession
    blobs = df.select(blob_of(text_of(text_col)).alias("blob"), text_of(text_col).alias("text")).dropDuplicates(["blob"])
    seen = read_ledger(spark, ledger_path)
    done = seen.filter(_among(rules)).groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("done"))
    unseen = blobs.join(done, "blob", "left")
    finds = []
    for r in rules:
        this = F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"))
        is_done = F.coalesce(F.array_contains("done", this), F.lit(False))
        spans = F.when(~is_done, find_spans(F.col("text"), r))
        finds.append(F.struct(F.lit(r.name).alias("rule"), F.lit(r.version).alias("version"), spans.alias("spans")))
    new = unseen.select("blob", F.explode(F.array(*finds)).alias("f")).filter(F.col("f.spans").isNotNull())
    new.select("blob", "f.rule", "f.version", "f.spans").write.mode("append").parquet(ledger_path)
    return read_ledger(spark, ledger_path)


def findings(df: DataFrame, ledger: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES,
             column: str = "found") -> DataFrame:
    """``df`` plus ``column``: per row the sorted ``(start, kind, end, rule)`` of all rules' spans in its text.

    ``kind`` numbers the rules in the order given.  Every row stays, repeated
    ones too; NULL and empty texts have an empty list, an empty table has no
    rows.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))])
    rows = ledger.filter(_among(rules) & (F.size("spans") > 0)).select("blob", "rule", F.explode("spans").alias("s"))
    row = F.struct(F.col("s.start").alias("start"), order[F.col("rule")].alias("kind"), F.col("s.end").alias("end"), "rule")
    by_blob = rows.groupBy("blob").agg(F.sort_array(F.collect_set(row)).alias(column))
    blob = fresh(df, "__blob")
    hashed = df.drop(column).withColumn(blob, blob_of(text_of(text_col)))
    found = hashed.join(by_blob.withColumnRenamed("blob", blob), blob, "left")
    empty = F.array().cast(by_blob.schema[column].dataType)
    return found.withColumn(column, F.coalesce(column, empty)).drop(blob)


def redact(df: DataFrame, text_col: str = "text", found_col: str = "found", mask: str = "[SECRET]") -> Column:
    """The text with every span of ``found_col`` (overlapping ones together) replaced by ``mask``; NULL stays NULL."""
    text, found = F.col(f"`{text_col}`").cast("string"), F.col(f"`{found_col}`")

    def step(state: Column, s: Column) -> Column:
        before = F.substring(text, state["at"] + 1, F.greatest(s["start"] - state["at"], F.lit(0)))
        part = F.when(s["start"] >= state["at"], F.concat(before, F.lit(mask))).otherwise(F.lit(""))
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["parts"], F.array(part)).alias("parts")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    joined = lambda s: F.concat(F.array_join(s["parts"], ""), F.substring(text, s["at"] + 1, F.length(text)))
    return F.when(F.size(found) > 0, F.aggregate(found, start, step, joined)).otherwise(text)


def redact_secrets(df: DataFrame, ledger_path: str, text_col: str = "text") -> DataFrame:
    """``df`` with the secrets of its texts masked; every row stays, and so do its other columns but ``n_chars``."""
    name = fresh(df, "__found")
    found = findings(df, scan(df, ledger_path, text_col), text_col, column=name)
    masked = found.withColumn(text_col, redact(found, text_col, name))
    hit = F.size(name) > 0
    for c in df.columns:
        if c == "n_chars":
            masked = masked.withColumn(c, F.when(hit, F.length(text_col).cast("long")).otherwise(F.col(c)))
    return masked.select(*df.columns)


def _spelled(found: Column) -> Column:
    return F.array_join(
        F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def op5_secrets(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ledger = scan(docs, scratch_path(spark, "secret-ledger"))
    found = findings(docs, ledger)
    of = lambda r: F.filter("found", lambda s: s["rule"] == r.name)
    base = F.filter("found", lambda s: s["kind"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *[F.size(of(r)).cast("long").alias(f"n_{r.name}") for r in BASE_RULES],
        F.sha2(_spelled(base), 256).alias("base_sha256"),
        _spelled(F.col("found")).alias("spans"),
    )


def _oracle_kind(name: str, pattern: str, group: int, least: int) -> str:
    """Spans of one rule as rows, from the gaps between matches and the matches."""
    return f"""
  SELECT blob, '{name}' AS rule, s, s + length(w) AS e FROM (
    SELECT blob, unnest(whole) AS w, unnest(part) AS g,
           unnest(list_transform(whole, lambda m, i:
             CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT blob, regexp_extract_all(t, '{pattern}', 0) AS whole, regexp_extract_all(t, '{pattern}', {group}) AS part,
                 regexp_split_to_array(t, '{pattern}') AS gaps FROM blobs) m)
  WHERE length(g) >= {least}"""


_ORACLE_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
ORACLE = f"""
WITH blobs AS (SELECT DISTINCT coalesce(text, '') AS t, sha256(coalesce(text, '')) AS blob FROM documents),
spans AS ({_oracle_kind("assign", _ORACLE_ASSIGN, 2, 6)}
  UNION ALL {_oracle_kind("access", "AKIA[A-Z0-9]+", 0, 20)}
  UNION ALL {_oracle_kind("hex", "[0-9a-f]+", 0, 24)}
  UNION ALL {_oracle_kind("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)}
  UNION ALL {_oracle_kind("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 20)}),
k AS (SELECT *, list_position(['assign', 'access', 'hex', 'pem', 'jwt'], rule) AS kind,
             concat(rule, ':', s, ':', e) AS spelled FROM spans),
f AS (SELECT blob, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access,
             count(*) FILTER (rule = 'hex') AS n_hex,
             coalesce(string_agg(spelled, ',' ORDER BY s, kind) FILTER (kind <= 3), '') AS base,
             string_agg(spelled, ',' ORDER BY s, kind) AS spans
      FROM k GROUP BY blob)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(f.spans, '') AS spans
FROM documents d LEFT JOIN f ON sha256(coalesce(d.text, '')) = f.blob
"""
