"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans are found by the base patterns. Weak candidates are shorter access identifiers, random-looking tokens and
endpoints; each alone means little, so one is reported only when a complementary part lies in its scope (at most
`SCOPE` characters between two spans of a text): a weak access identifier needs a secret or an endpoint, a weak secret needs an
access identifier or an endpoint, and an endpoint needs both an identifier and a secret. The join of intervals runs inside
a row over its spans in order: the furthest end of each part seen before a span, and the nearest start of each part after it,
decide it. So no rows are shuffled, and the work is linear in the text.

Positions are code points, ends exclusive. Texts are scanned whole. Edge cases: a null text counts as empty; a text without
spans has the empty string as `spans` and its hash as base_sha256; rows with equal or null ids each give a row; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCOPE = 200
#: Elements of an array that are appended to one another before they are joined to the rest.
PART = 512

#: Fixed patterns. Both regular expression engines read them alike: no look-around, no case folding.
_KEYWORD = "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key")) + ")"
BASE = {
    "assign": (_KEYWORD + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 0),
    "access": ("AKIA[A-Z0-9]+", 16),
    "hex": ("[0-9a-f]{32,}", 32),
}
_ASSIGN_VALUE = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
WEAK = {
    "weak_access": "A[KS]IA[A-Z0-9]{4,}",
    "weak_secret": "[A-Za-z0-9+/_-]{20,}",
    "weak_endpoint": "[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~%:/?#@!$&()*+,;=-]+",
}
KINDS = [*BASE, *WEAK]
PART_OF = {"assign": "secret", "access": "access", "hex": "secret", "weak_access": "access", "weak_secret": "secret", "weak_endpoint": "endpoint"}
_SPAN = "struct<start:int,end:int,rank:int,good:boolean>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once per row: an expression that a lambda holds is else computed at each call."""
    return F.element_at(F.transform(F.array(value), use), 1)


def scan(items: Column, zero: Column, state: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], kind: str) -> Column:
    """Running fold of an array: out(state before, item) for each item. kind: type of the results.

    Results are gathered in parts of PART elements, so that appending doesn't copy a long array each time.
    """
    none = F.array().cast(f"array<{kind}>")

    def within(s: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(s.alias("s"), none.alias("o")), lambda b, x: F.struct(state(b["s"], x).alias("s"), F.concat(b["o"], F.array(out(b["s"], x))).alias("o")))

    def folded(rows: Column) -> Column:
        starts = F.when(F.size(rows) > 0, F.sequence(F.lit(0), F.size(rows) - 1, F.lit(PART))).otherwise(F.array().cast("array<int>"))
        part = lambda at: F.slice(rows, at + 1, F.lit(PART))
        # The state at each part's start, then each part by itself: parts are joined once.
        entry = lambda at, s: F.struct(at.alias("at"), s.alias("s"))
        states = F.aggregate(
            starts, F.struct(zero.alias("s"), F.array(entry(F.lit(0), zero)).alias("o")),
            lambda acc, at: let(F.aggregate(part(at), acc["s"], state), lambda s: F.struct(s.alias("s"), F.concat(acc["o"], F.array(entry(at + PART, s))).alias("o"))),
        )["o"]
        return F.flatten(F.transform(F.slice(states, 1, F.size(starts)), lambda e: within(e["s"], part(e["at"]))["o"]))

    return let(items, folded)


def _spans(text: Column, kind: str) -> Column:
    """All matches of a kind's pattern as structs (start, end, rank, good): text between matches and matches themselves, alternately."""
    pattern = BASE[kind][0] if kind in BASE else WEAK[kind]
    none = F.array().cast(f"array<{_SPAN}>")
    rank = F.lit(KINDS.index(kind))

    def good(m: Column) -> Column:
        if kind == "assign":
            return F.length(F.regexp_extract(m, _ASSIGN_VALUE, 1)) >= 8
        if kind == "weak_secret":
            return m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")
        return F.length(m) >= BASE.get(kind, ("", 0))[1]

    def placed(x: Column) -> Column:
        items = F.zip_with(F.slice(x["gaps"], 1, F.size(x["found"])), x["found"], lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("len"), good(m).alias("good")))
        return scan(
            items, F.lit(0), lambda s, x: s + x["gap"] + x["len"],
            lambda s, x: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + x["len"]).alias("end"), rank.alias("rank"), x["good"].alias("good")), _SPAN,
        )

    both = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    # A cheap test of fixed letters first, where a pattern has some.
    letters = {"access": text.contains("AKIA"), "weak_access": text.contains("AKIA") | text.contains("ASIA"), "weak_endpoint": text.contains("://")}.get(kind)
    may = text.rlike(pattern) if letters is None else letters & text.rlike(pattern)
    return F.when(may, F.filter(let(both, placed), lambda x: x["good"])).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _is(x: Column, part: str) -> Column:
    return x["rank"].isin([i for i, k in enumerate(KINDS) if PART_OF[k] == part])


def _near(spans: Column, backwards: bool) -> Column:
    """For each span in order: whether an access identifier, a secret, an endpoint that lies before (or after) it is in scope."""
    parts = ("access", "secret", "endpoint")
    far = F.lit(1 << 30)
    ordered = F.reverse(spans) if backwards else spans
    edge = lambda x: -x["start"] if backwards else x["end"]
    own = lambda x: -x["end"] if backwards else x["start"]
    zero = F.struct(*((-far).alias(p) for p in parts))
    out = scan(
        ordered, zero, lambda s, x: F.struct(*(F.when(_is(x, p), F.greatest(s[p], edge(x))).otherwise(s[p]).alias(p) for p in parts)),
        lambda s, x: F.struct(*((own(x) - s[p] <= SCOPE).alias(p) for p in parts)), "struct<access:boolean,secret:boolean,endpoint:boolean>",
    )
    return F.reverse(out) if backwards else out


def secret_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with the columns secret_base and secret_all: arrays of structs (start, end, rank of the kind in KINDS)."""
    text = F.coalesce(df[text_col], F.lit(""))
    key = lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"))
    unkey = lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"))
    rows = df.withColumns({f"_secret_{k}": _spans(text, k) for k in KINDS})
    base = F.transform(F.array_sort(F.transform(F.concat(*(F.col(f"_secret_{k}") for k in BASE)), key)), unkey)
    rows = rows.withColumn("secret_base", base)
    # Weak candidates that no base span touches: an order by start and the furthest end so far tell.
    weak = F.concat(*(F.col(f"_secret_{k}") for k in WEAK))
    mixed = F.transform(F.array_sort(F.transform(F.concat(F.col("secret_base"), F.transform(weak, unkey)), key)), unkey)
    rows = rows.withColumn("_secret_mixed", mixed)
    strong = lambda x: x["rank"] < len(BASE)
    before = scan(F.col("_secret_mixed"), F.lit(0), lambda s, x: F.when(strong(x), F.greatest(s, x["end"])).otherwise(s), lambda s, x: s > x["start"], "boolean")
    after = F.reverse(scan(F.reverse(F.col("_secret_mixed")), F.lit(1 << 30), lambda s, x: F.when(strong(x), F.least(s, x["start"])).otherwise(s), lambda s, x: s < x["end"], "boolean"))
    flagged = F.zip_with(F.arrays_zip(F.col("_secret_mixed").alias("x"), before.alias("a")), after, lambda p, q: F.struct(p["x"].alias("x"), (strong(p["x"]) | ~(p["a"] | q)).alias("ok")))
    no_weak = F.size(weak) == 0
    rows = rows.withColumn("_secret_parts", F.when(no_weak, F.col("secret_base")).otherwise(F.transform(F.filter(flagged, lambda p: p["ok"]), lambda p: p["x"])))
    near = F.zip_with(_near(F.col("_secret_parts"), False), _near(F.col("_secret_parts"), True), lambda a, b: F.struct(*((a[p] | b[p]).alias(p) for p in ("access", "secret", "endpoint"))))
    linked = F.zip_with(
        F.col("_secret_parts"), near,
        lambda x, n: F.struct(x.alias("x"), (strong(x) | (_is(x, "access") & (n["secret"] | n["endpoint"])) | (_is(x, "secret") & (n["access"] | n["endpoint"])) | (_is(x, "endpoint") & n["access"] & n["secret"])).alias("ok")),
    )
    rows = rows.withColumn("secret_all", F.when(no_weak, F.col("secret_base")).otherwise(F.transform(F.filter(linked, lambda p: p["ok"]), lambda p: p["x"])))
    return rows.drop(*(f"_secret_{k}" for k in KINDS), "_secret_mixed", "_secret_parts")


def secret_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, counts of the base kinds, the hash of the base spans, all spans as text."""
    rows = secret_spans(df.select(df[id_col].alias("doc_id"), df[text_col].alias("text")))
    count = lambda k: F.size(F.filter("secret_base", lambda x: x["rank"] == KINDS.index(k))).cast("long")
    return rows.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"), _joined(F.col("secret_all")).alias("spans"))


def masked(df: DataFrame, text_col: str = "text", mark: str = "<secret>") -> DataFrame:
    """df with each reported span of the text replaced by a mark; overlapping spans are replaced once. A null text stays null."""
    rows = secret_spans(df.select(F.struct("*").alias("row"), df[text_col].alias("text")))
    text = F.col("text")
    # Cut points: the start of each span past the furthest end so far, and that end.
    kept = scan(F.col("secret_all"), F.lit(0), lambda s, x: F.greatest(s, x["end"]), lambda s, x: F.struct(s.alias("upto"), x["start"].alias("start")), "struct<upto:int,start:int>")
    last = F.aggregate("secret_all", F.lit(0), lambda s, x: F.greatest(s, x["end"]))
    pieces = F.transform(F.filter(kept, lambda k: k["start"] >= k["upto"]), lambda k: F.concat(F.substring(text, k["upto"] + 1, k["start"] - k["upto"]), F.lit(mark)))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, last + 1, F.length(text)))
    return rows.select(F.col("row").withField(text_col, F.when(F.size("secret_all") > 0, clean).otherwise(text)).alias("row")).select("row.*")


def _sql() -> str:
    """DuckDB SQL for secret_report() over `documents`."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    parts = []
    for rank, kind in enumerate(KINDS):
        pattern = BASE[kind][0] if kind in BASE else WEAK[kind]
        good = {"assign": f"length(regexp_extract(m, {quoted(_ASSIGN_VALUE)}, 1)) >= 8", "weak_secret": "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')"}.get(kind, f"length(m) >= {BASE.get(kind, ('', 0))[1]}")
        parts.append(f"""SELECT doc_id, {rank} AS rank, (upto - length(m))::BIGINT AS s, upto::BIGINT AS e, {good} AS good FROM (
            SELECT doc_id, m, sum(length(m) + length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM (
                SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, unnest(range(len(ms))) AS i
                FROM (SELECT doc_id, regexp_extract_all(t, {quoted(pattern)}) AS ms, regexp_split_to_array(t, {quoted(pattern)}) AS gaps FROM d)))""")
    part = "CASE " + " ".join(f"WHEN rank = {i} THEN '{PART_OF[k]}'" for i, k in enumerate(KINDS)) + " END"
    name = "CASE x.rank " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END"
    near = lambda p: f"EXISTS (SELECT 1 FROM c y WHERE y.doc_id = x.doc_id AND y.part = '{p}' AND (y.s, y.e, y.rank) IS DISTINCT FROM (x.s, x.e, x.rank) AND greatest(y.s - x.e, x.s - y.e) <= {SCOPE})"
    count = lambda k: f"count(*) FILTER (x.rank = {KINDS.index(k)})::BIGINT AS n_{k}"
    joined = f"string_agg({name} || ':' || x.s || ':' || x.e, ',' ORDER BY x.s, x.rank)"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    , a AS ({" UNION ALL ".join(parts)})
    , b AS (SELECT * FROM a WHERE good)
    , c AS (SELECT *, {part} AS part FROM b x WHERE rank < {len(BASE)} OR NOT EXISTS (SELECT 1 FROM b y WHERE y.doc_id = x.doc_id AND y.rank < {len(BASE)} AND y.s < x.e AND x.s < y.e))
    , l AS (SELECT * FROM c x WHERE rank < {len(BASE)} OR (part = 'access' AND ({near("secret")} OR {near("endpoint")}))
        OR (part = 'secret' AND ({near("access")} OR {near("endpoint")})) OR (part = 'endpoint' AND {near("access")} AND {near("secret")}))
    SELECT d.doc_id, {", ".join(count(k) for k in BASE)}, sha256(coalesce({joined} FILTER (x.rank < {len(BASE)}), '')) AS base_sha256, coalesce({joined}, '') AS spans
    FROM d LEFT JOIN l x USING (doc_id) GROUP BY d.doc_id"""


SQL = _sql()
