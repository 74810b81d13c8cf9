"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Every text is searched for the base kinds (assign, access, hex) and for
further kinds of credentials.  Positions come from the pieces between the
matches: `split` by the same pattern gives the gaps, and prefix sums over gap
and match lengths give code-point offsets.

The value of each candidate is hashed.  A value's frequency is counted by
distinct repositories (here: documents) and distinct owners (here: sources).
A value held by `example_owners` owners or more is a widely copied example;
any other is owner-specific and looks live.  Base spans are always reported;
spans of the further kinds are added when they look live.

Counts are combined before each shuffle: a text names a value once, and
(value, owner) pairs are summed on the map side, so a value that a third of
all documents share is a few rows per task.  Only example values are joined
back; the join on the hash is a plain equi-join that adaptive execution may
split.

Defined cases: null texts count as empty and have no spans; a null owner is
an owner of its own; a match shorter than its kind's minimum is dropped after
matching (its characters are used up); spans of different kinds may overlap;
a private key is the whole block and its value the body between the lines;
one row is returned per input row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, pick, with_row, written

# Fixed values: (kind, pattern, group holding the value, minimum length of the value), base kinds first.
BASE_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
MORE_KINDS = (
    # to the END line of the same type; without one, to the next key or the end of the text
    ("pem", r"-----BEGIN (?<type>[A-Z ]*)PRIVATE KEY-----((?s:.*?))"
            r"(?:-----END \k<type>PRIVATE KEY-----|(?=-----BEGIN [A-Z ]*PRIVATE KEY-----)|\z)", 2, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("github", r"gh[opsur]_[A-Za-z0-9]+", 0, 24),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("bearer", r"[Bb]earer ([A-Za-z0-9+/_.=-]+)", 1, 16),
    ("url", r"[a-z][a-z0-9+]*://[^\s:/@]+:([^\s:/@]+)@", 1, 1),
)
#: A cheap test before the full search of a kind: runs that no match can do without.
QUICK = {"hex": r"[0-9a-f]{24}", "access": r"AKIA[A-Z0-9]{16}", "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----"}
KINDS = BASE_KINDS + MORE_KINDS
EXAMPLE_OWNERS = 3

SPAN = "struct<start:int,kind_no:int,end:int,kind:string,hash:string>"


def _spans(text: Column, number: int) -> Column:
    """Spans of one kind: start and end in code points, end exclusive; hash of the value."""
    kind, pattern, group, least = KINDS[number]
    matches = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(group + 1))
    parts = F.arrays_zip(matches.alias("match"), values.alias("value"), F.split(text, pattern, -1).alias("gap"))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"CAST(array() AS array<{SPAN}>)").alias("spans"))

    def step(a, x):
        start = a["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"),
                        F.sha2(F.encode(x["value"], "UTF-8"), 256).alias("hash"))
        # the last gap has no match: length 0 is never enough
        fits = F.coalesce(F.length(x["value"]), F.lit(0)) >= least
        return F.struct(F.coalesce(end, start).alias("at"), F.when(fits, F.array_append(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    found = F.aggregate(parts, begin, step, lambda a: a["spans"])
    return F.when(text.rlike(QUICK.get(kind, pattern)), found).otherwise(F.expr(f"CAST(array() AS array<{SPAN}>)"))


def find_candidates(docs: DataFrame) -> DataFrame:
    """Adds `found`, the spans of all kinds by start, then kind."""
    text = F.coalesce(F.col("text"), F.lit(""))
    per_kind = docs.select("*", *[_spans(text, i).alias(f"_k{i}") for i in range(len(KINDS))])
    found = F.sort_array(F.concat(*[F.col(f"_k{i}") for i in range(len(KINDS))]))
    return per_kind.withColumn("found", found).drop(*[f"_k{i}" for i in range(len(KINDS))])


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners of every candidate value; `found` has one row per repository."""
    each = found.select("owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    per_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count(F.lit(1)).alias("n_owners"))


def scan_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", owner: str = "source",
                 example_owners: int = EXAMPLE_OWNERS, row: str | None = None) -> DataFrame:
    """One row per document row: _row (`row` if named), doc_id, found (spans with `live`), by start, then kind."""
    columns = {"doc_id": doc_id, "text": text, "owner": owner}
    d = pick(docs, **columns, _row=row) if row else with_row(pick(docs, **columns))
    found = written(find_candidates(d).drop("text"), "secret-candidates")
    examples = ownership(found).where(F.col("n_owners") >= example_owners).select("hash", F.lit(False).alias("live"))
    each = found.where(F.size("found") > 0).select("_row", F.explode("found").alias("s"))
    judged = (each.join(examples, each["s.hash"] == examples["hash"], "left")
              .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct(
                  "s.start", "s.kind_no", "s.end", "s.kind", F.coalesce("live", F.lit(True)).alias("live")))).alias("judged")))
    none = F.expr("CAST(array() AS array<struct<start:int,kind_no:int,end:int,kind:string,live:boolean>>)")
    return (found.select("_row", "doc_id").join(judged, "_row", "left")
            .select("_row", "doc_id", F.coalesce("judged", none).alias("found")))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, **columns) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example."""
    s = scan_secrets(docs, **columns)
    n_base = len(BASE_KINDS)
    counts = [F.size(F.expr(f"filter(found, x -> x.kind_no = {i})")).cast("long").alias(f"n_{BASE_KINDS[i][0]}")
              for i in range(n_base)]
    base = F.filter("found", lambda x: x["kind_no"] < n_base)
    return s.select("doc_id", *counts, F.sha2(F.encode(_listed(base), "UTF-8"), 256).alias("base_sha256"),
                    _listed(F.filter("found", lambda x: (x["kind_no"] < n_base) | x["live"])).alias("spans"),
                    F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
                    F.size(F.filter("found", lambda x: ~x["live"])).cast("long").alias("n_example"))


def redact(docs: DataFrame, mark: str = "[REDACTED]", text: str = "text", doc_id: str = "doc_id", owner: str = "source",
           example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """`docs` with every live-looking span (overlapping ones as one) replaced by `mark`; all rows and columns stay."""
    d, key = keyed(docs)
    s = scan_secrets(d, text, doc_id, owner, example_owners, key)
    spans = f"{key}_live"
    live = s.select(F.col("_row").alias(key), F.filter("found", lambda x: x["live"]).alias(spans)).where(F.size(spans) > 0)
    d = d.join(live, key, "left")
    t = F.col(f"`{text}`")
    begin = F.struct(F.lit(0).alias("upto"), F.lit("").alias("out"))

    def step(a, x):
        piece = F.when(x["start"] >= a["upto"], F.concat(a["out"], F.substring(t, a["upto"] + 1, x["start"] - a["upto"]), F.lit(mark)))
        return F.struct(F.greatest(a["upto"], x["end"]).alias("upto"), piece.otherwise(a["out"]).alias("out"))

    cleaned = F.aggregate(spans, begin, step, lambda a: F.concat(a["out"], F.substring(t, a["upto"] + 1, F.length(t))))
    return d.withColumn(text, F.when(F.col(spans).isNotNull(), cleaned).otherwise(t)).drop(key, spans)
