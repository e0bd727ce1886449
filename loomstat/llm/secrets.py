"""Secret scans (operator 7, built-in functions only).

Three base patterns find assigned secrets, access keys and long hexadecimal
runs. Two character models then judge the remaining long tokens: one Markov
chain of random strings, one of ordinary identifiers. A token is reported as
``random`` when its log-likelihood ratio per character exceeds a margin.

The chains are trained from labelled samples: tokens of a bounded sample of
documents (``SAMPLE`` rows of smallest id hash) count as ordinary unless they
lie in a base match; base matches of the sample, and digests of its ids in
base64, hexadecimal and upper case, count as random. Their counts are bounded
by the alphabet, 128 x 128 pairs each, and are all that reaches the driver.

Positions are code points, the end exclusive. Defined results: a null or empty
text has no spans; rows are judged one by one, so repeated rows get equal
results; other columns are ignored; an empty table gives no rows (and chains of
pseudo-counts only).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A maximal run of 24 and more is what remains of all runs once shorter ones are dropped; likewise 20 and more after the mark.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ASSIGN_LEAST = 6
#: Documents whose tokens train the chains.
SAMPLE = 1000
#: Log-likelihood ratio per character above which a token counts as random.
MARGIN = 0.5
CODES = 128
#: Weight of the smoothing, in pairs.
PRIOR = 4.0


#: Matches of a text are walked in runs of this length, so that lists grow by runs, not by single matches.
RUN = 64
NO_SPANS = "cast(array() as array<struct<start:bigint,kind:int,end:bigint,token:string>>)"


def _found(text: Column, pattern: str, kind: int, measured: int = 0, least: int = 0) -> Column:
    """``array<struct(start, kind, end, token)>`` of the leftmost
    non-overlapping matches: what splitting leaves between them tells where
    they lie. Places are running sums: first over runs of matches, then inside each run."""
    def spans(rows: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int")), lambda k: F.slice(rows, k * RUN + 1, RUN))
        length = lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda n, r: n + r["gap"] + F.coalesce(r["len"], F.lit(0).cast("long")))
        begins = F.aggregate(
            runs, F.array(F.lit(0).cast("long")), lambda at, run: F.concat(at, F.array(F.element_at(at, -1) + length(run))))

        def walk(run: Column, begin: Column) -> Column:
            start = F.struct(begin.alias("at"), F.expr(NO_SPANS).alias("out"))

            def step(acc: Column, row: Column) -> Column:
                first = acc["at"] + row["gap"]
                end = first + F.coalesce(row["len"], F.lit(0).cast("long"))
                span = F.struct(first.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), row["token"].alias("token"))
                return F.struct(end.alias("at"), F.when(row["key"] >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

            return F.aggregate(run, start, step, lambda acc: acc["out"])

        return F.flatten(F.transform(F.arrays_zip(runs.alias("run"), F.slice(begins, F.lit(1), F.size(runs)).alias("begin")), lambda r: walk(r["run"], r["begin"])))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measure = F.regexp_extract_all(text, F.lit(pattern), F.lit(measured)) if measured else hits
    rows = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long")).alias("gap"), hits.alias("token"),
        F.transform(hits, lambda m: F.length(m).cast("long")).alias("len"),
        F.transform(measure, lambda m: F.length(m).cast("long")).alias("key"))
    # the lambda binds the rows once
    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(rows), spans), 1)).otherwise(F.expr(NO_SPANS))


def _placed(spans: Column) -> Column:
    """The spans without their texts."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def _codes(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.ascii(c))


def _pairs(token: Column) -> Column:
    """Numbers of the character pairs of an ASCII token."""
    codes = _codes(token)
    return F.zip_with(F.slice(codes, F.lit(1), F.size(codes) - 1), F.slice(codes, F.lit(2), F.size(codes) - 1), lambda a, b: a * CODES + b)


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[float]:
    """Log-likelihood ratio of each character pair, random against ordinary."""
    rows = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("id"))
    last = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # only hashes move
    rows = rows.where(F.col("h") <= F.lit(last).cast("long"))
    digest = F.sha2("id", 256)
    noise = [F.translate(F.base64(F.unhex(F.sha2(F.concat("id", F.lit(salt)), 512))), "\r\n", "") for salt in (" one", " two")]
    base = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(g)) for p, g in ((ASSIGN, 2), (ACCESS, 0), (HEX, 0))])
    random = F.concat(base, F.array(*noise, F.substring(digest, 1, 40), F.upper(F.substring(F.translate(noise[0], "+/=", ""), 1, 20))))
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = F.regexp_extract_all(without, F.lit(r"[A-Za-z0-9+/_=-]{3,}"), F.lit(0))
    counts = (
        rows.select(F.explode(F.array(F.struct(F.lit(True).alias("random"), random.alias("tokens")),
                                      F.struct(F.lit(False).alias("random"), ordinary.alias("tokens")))).alias("c"))
        .select("c.random", F.explode("c.tokens").alias("token")).where(F.length("token") > 1)
        .select("random", F.explode(_pairs(F.col("token"))).alias("pair"))
        .groupBy("random", "pair").count()
    )
    seen = {(r["random"], r["pair"]): r["count"] for r in counts.collect()}  # at most 2 x 128 x 128 numbers
    allowed = [ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]
    chain = {}
    for k in (True, False):  # a pair is smoothed by how often its second character follows any
        after = {b: sum(seen.get((k, a * CODES + b), 0) for a in allowed) + 1 for b in allowed}
        every = sum(after.values())
        for a in allowed:
            total = sum(seen.get((k, a * CODES + b), 0) for b in allowed)
            for b in allowed:
                chain[k, a, b] = (seen.get((k, a * CODES + b), 0) + PRIOR * after[b] / every) / (total + PRIOR)
    out = [0.0] * (CODES * CODES)
    for a in allowed:
        for b in allowed:
            out[a * CODES + b] = math.log(chain[True, a, b] / chain[False, a, b])
    return out


def _random_tokens(text: Column, ratios: list[float], margin: float) -> Column:
    """Spans of tokens that the chains take for random; they hold a letter."""
    table = F.split(F.lit(",".join(f"{x:.6g}" for x in ratios)), ",").cast("array<double>")
    score = lambda t: F.aggregate(_pairs(t), F.lit(0.0), lambda s, p: s + F.get(table, p)) / (F.length(t) - 1)
    spans = _found(text, TOKEN, KINDS.index("random"))
    return _placed(F.filter(spans, lambda s: s["token"].rlike("[A-Za-z]") & (score(s["token"]) > margin)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratios: list[float] | None = None,
         margin: float = MARGIN) -> DataFrame:
    """``doc_id, base, found``: arrays of ``(start, kind, end)`` in order, the
    base spans and all spans. Random tokens that touch a base span add none."""
    ratios = train(df, id_col, text_col) if ratios is None else ratios
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.sort_array(_placed(F.concat(_found(text, ASSIGN, 0, measured=2, least=ASSIGN_LEAST), _found(text, ACCESS, 1), _found(text, HEX, 2))))
    rows = df.select(F.col(id_col).alias(id_col), text.alias("__text"), base.alias("base"))
    more = F.filter(_random_tokens(F.col("__text"), ratios, margin), lambda s: ~F.exists(
        F.col("base"), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return rows.select(id_col, "base", F.sort_array(F.concat("base", more)).alias("found"))


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        id_col, *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))
