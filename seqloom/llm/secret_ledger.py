"""Secret scans over an incremental blob ledger, in DataFrame operations only.

* Every version of every path is addressed by the SHA-256 of its content (*blob*).
* The *ledger* holds a row for each scanned pair of blob and rule version, with the
  spans found.  A run scans only pairs that the ledger lacks, each blob once however
  many paths share it; a rule whose version rises is scanned again on its own.
* Findings are joined back to all paths by blob.

A rule's matches are leftmost and don't overlap.  Their places come from splitting
the text at the matches: the lengths of the pieces between and of the matches add up
to code-point offsets, first within runs of RUN matches and then over runs, so a text with very many
matches takes little more than its length, and no row-at-a-time code is needed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.llm._shared import materialize


@dataclass(frozen=True)
class Rule:
    """``pattern`` (Java) finds matches; those whose ``group`` is shorter than ``least`` are dropped.

    ``probe`` is a cheaper pattern that any kept match contains.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    probe: str


#: The kinds of secrets, in the order of a tie at one place.
BASE_RULES = (
    Rule("assign", 1, r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6, r"(?i)(?:passw(?:or)?d|secret|token|api_?key)[\"']?\x20*[:=]"),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}+", 0, 24, r"[0-9a-f]{24}"),
)
#: Kinds that the method adds to the base ones.
ADDED_RULES = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("pat", 1, r"gh[opsu]_[A-Za-z0-9]{36,}+", 0, 40, r"gh[opsu]_[A-Za-z0-9]{36}"),
)
RULES = BASE_RULES + ADDED_RULES

_SPANS = "array<struct<start:bigint,stop:bigint>>"
#: Matches whose offsets are added up one by one.
RUN = 128


def _spans(text: Column, rule: Rule) -> Column:
    """Kept matches of a rule as ``array<struct<start, stop>>``, offsets in code points."""
    between = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = whole if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    steps = F.zip_with(
        F.zip_with(F.slice(between, 1, F.size(whole)), whole, lambda a, b: F.struct(F.length(a).cast("long").alias("gap"), F.length(b).cast("long").alias("len"))),
        kept,
        lambda s, k: F.struct(s["gap"].alias("gap"), s["len"].alias("len"), (F.length(k) >= rule.least).alias("kept")),
    )
    none, zero = F.array().cast(_SPANS), F.lit(0).cast("long")

    def within(run: Column) -> Column:
        """``at``, the code points of a run of matches, and ``found``, its kept ones from the run's start."""
        return F.aggregate(
            run,
            F.struct(zero.alias("at"), none.alias("found")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["len"]).alias("at"),
                F.when(s["kept"], F.concat(acc["found"], F.array(F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["len"]).alias("stop"))))).otherwise(acc["found"]).alias("found"),
            ),
        )

    def over(runs: Column) -> Column:
        starts = F.aggregate(runs, F.array(zero), lambda acc, r: F.concat(acc, F.array(F.element_at(acc, -1) + r["at"])))
        moved = F.zip_with(runs, starts, lambda r, at: F.transform(r["found"], lambda s: F.struct((s["start"] + at).alias("start"), (s["stop"] + at).alias("stop"))))
        return F.flatten(F.filter(moved, lambda x: x.isNotNull()))

    # transform(array(x), ...)[0] names x once, where a lambda would compute it for each element.
    cut = lambda all_steps: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(all_steps) - 1, F.lit(0)) / RUN).cast("int")), lambda i: within(F.slice(all_steps, i * RUN + 1, F.lit(RUN))))
    runs = F.transform(F.array(steps), cut)[0]
    folded = F.transform(F.array(runs), over)[0]
    return F.when(text.rlike(rule.probe), folded).otherwise(none)


def paths_with_blobs(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """``path, blob``: the content address of every row; a null text is as an empty one."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """New rows of the ledger: ``blob, kind, version, spans`` for pairs it lacks.

    ``versions`` is every historical version of every path.  Blobs are made unique
    before a text is scanned (with a partial step on each input partition, so a blob
    held by a third of all rows meets as a few rows).  Pairs without a finding get a
    row too: they are seen.  Without rows, the result is empty.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    blobs = versions.select(F.sha2(body, 256).alias("blob"), body.alias("body"))
    if ledger is not None:
        seen = ledger.select("blob", "kind", "version").distinct().groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("seen"))
        blobs = blobs.groupBy("blob").agg(F.any_value("body").alias("body")).join(seen, "blob", "left")
        todo = lambda r: ~F.coalesce(F.array_contains("seen", f"{r.kind}:{r.version}"), F.lit(False))
        blobs = blobs.where(reduce(lambda a, b: a | b, [todo(r) for r in rules]))
    else:
        blobs = blobs.groupBy("blob").agg(F.any_value("body").alias("body"))
        todo = lambda r: F.lit(True)
    rows = F.array(*[F.when(todo(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), _spans(F.col("body"), r).alias("spans"))) for r in rules])
    return blobs.select("blob", F.explode(rows).alias("row")).where("row is not null").select("blob", "row.*")


def join_findings(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``path, blob`` and, for each rule, ``found_<kind>``: all paths with their blob's spans.

    Only ledger rows with spans move; every path keeps its row.  A blob that very many paths hold is
    one row on the ledger's side, so the join can be dealt out anew on the side of the paths (as
    adaptive execution does for a skewed outer join).
    """
    current = reduce(lambda a, b: a | b, [(F.col("kind") == r.kind) & (F.col("version") == r.version) for r in rules])
    found = ledger.where(current & (F.size("spans") > 0)).groupBy("blob").agg(*[F.any_value(F.when(F.col("kind") == r.kind, F.col("spans")), True).alias(f"found_{r.kind}") for r in rules])
    return paths.join(found, "blob", "left")


def _joined(kinds: list[str]) -> Column:
    """``kind:start:stop`` of these kinds by start, then by the order of kinds."""
    none = F.array().cast("array<struct<start:bigint,nth:int,stop:bigint,kind:string>>")

    def tagged(nth: int, kind: str) -> Column:
        spans = F.coalesce(F.col(f"found_{kind}"), F.array().cast(_SPANS))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(nth).alias("nth"), s["stop"].alias("stop"), F.lit(kind).alias("kind")))

    parts = [tagged(nth, kind) for nth, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(none, *parts)), lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def secret_report(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    With a ledger, only its missing pairs are scanned and old findings still count.
    Rows of one doc_id, or without one, stay rows of their own; empty and null texts have no spans; a text of any
    length is scanned as a whole, in time about linear in its length and matches; equal texts are scanned once; an empty
    table has no rows; other columns are ignored.
    """
    new = materialize(scan(docs, ledger, rules), "ledger")
    whole = new if ledger is None else new.unionByName(ledger.select(*new.columns))
    out = join_findings(paths_with_blobs(docs), whole, rules)
    counts = [F.when(F.col(f"found_{r.kind}").isNull(), F.lit(0)).otherwise(F.size(f"found_{r.kind}")).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES]
    return out.select(
        F.col("path").alias("doc_id"),
        *counts,
        F.sha2(_joined([r.kind for r in BASE_RULES]), 256).alias("base_sha256"),
        _joined([r.kind for r in rules]).alias("spans"),
        "blob",
    )


def _kind_sql(nth: int, rule: Rule) -> str:
    """Matches of a rule with their places: RE2 has no possessive quantifier, which only saves time here."""
    flags = "i" if rule.pattern.startswith("(?i)") else "c"
    pattern = rule.pattern.removeprefix("(?i)").replace("}+", "}").replace("'", "''").replace("{24,}", "+").replace("{36,}", "+")
    return (
        f"SELECT d.doc_id, d.blob, {nth} AS nth, '{rule.kind}' AS kind, {rule.least} AS least, string_split_regex(x, '{pattern}', '{flags}') AS gaps, "
        f"regexp_extract_all(x, '{pattern}', 0, '{flags}') AS hits, regexp_extract_all(x, '{pattern}', {rule.group}, '{flags}') AS parts FROM d"
    )


#: The report of a first scan in DuckDB SQL, for RULES.
REPORT_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x, sha256(coalesce(text, '')) AS blob FROM documents
), k AS (
  {" UNION ALL ".join(_kind_sql(nth, rule) for nth, rule in enumerate(RULES))}
), u AS (SELECT doc_id, nth, kind, least, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS i FROM k
), s AS (
  SELECT doc_id, nth, kind, list_sum(list_transform(gaps[:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda h: length(h))), 0) AS a, length(hits[i]) AS n
  FROM u WHERE length(parts[i]) >= least
), j AS (SELECT doc_id, nth, kind, a::BIGINT AS a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS span FROM s
), g AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)},
    string_agg(span, ',' ORDER BY a, nth) FILTER (WHERE nth < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY a, nth) AS spans FROM j GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, blob
FROM d LEFT JOIN g USING (doc_id)
"""
