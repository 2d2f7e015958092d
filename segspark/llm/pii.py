"""Personal data: base patterns, and bootstrapped contextual extraction.

The base patterns find spans of four kinds. These are the seeds: the one or two words before a seed
are lexical patterns, the identifiers are instances. A pattern's confidence is the score of the
instances behind it over all identifier-like tokens behind it in the corpus; it is admitted with
SEEDS distinct instances of score CONFIDENCE and that confidence itself. An instance's score is 1
for a seed, else what its admitted patterns give it. Spark runs rounds over this graph, in which
instances found so far support new patterns, until no pattern is admitted any more. Identifier-like
tokens behind admitted patterns become spans of kind `other`, beside the base ones.

All of it is DataFrame functions. Only pattern and instance hashes and counts are shuffled, summed
before they are. Every expression over a text takes linear time.

Edge cases: null and empty texts have no spans. Offsets are code points, ends exclusive. A repeated
row is evidence each time it occurs and is answered each time. Without seeds nothing is discovered.
Extra columns are ignored by `found` and kept by `redacted`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free, prepare, stored

KINDS = ("email", "ip", "card", "phone", "other")
#: Base patterns behind a gap, each match starting where the last one ended. Possessive, so linear.
_EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
#: Distinct instances that a pattern needs, and the least confidence of patterns and instances.
SEEDS, CONFIDENCE = 3, 0.6
#: An identifier-like token: at least this many digits.
DIGITS = 4

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
_TOKEN = "array<struct<start:int,value:string,before:string>>"


#: Matches folded at once; a text with n matches costs n * FOLD copies, not n * n.
FOLD = 256


def _folded(text: Column, pattern: str, kind: str, item) -> Column:
    """item(gap, value, start of value, start of gap) of each match behind its gap; array of `kind`."""
    whole = F.lit(pattern)
    found = F.arrays_zip(F.regexp_extract_all(text, whole, 1).alias("gap"), F.regexp_extract_all(text, whole, 2).alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(item(x["gap"], x["value"], start, acc["at"]))).alias("out"))

    def block(done: Column, part: Column) -> Column:
        at = F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0))
        return F.concat(done, F.array(F.aggregate(part, F.struct(at.alias("at"), F.expr(f"cast(array() as {kind})").alias("out")), step)))

    def whole_of(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(pairs), F.lit(FOLD)), lambda i: F.slice(pairs, i + 1, FOLD))
        return F.aggregate(blocks, F.expr(f"cast(array() as array<struct<at:int,out:{kind}>>)"), block, lambda done: F.flatten(F.transform(done, lambda d: d["out"])))

    # A lambda's variable is computed once; an expression in its body is computed for each element.
    return F.flatten(F.transform(F.array(found), whole_of))


def _spans(text: Column, gate: str, pattern: str, kind: str) -> Column:
    """Matches of pattern with their offsets, empty unless the text matches gate."""
    item = lambda gap, value, start, _: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))
    return F.when(text.rlike(gate), _folded(text, rf"(?s)\G(.*?)({pattern})", _SPAN, item)).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def base_spans(text: Column) -> Column:
    """array of (kind, start, end, value) by kind, then start."""
    digits = lambda s, drop: F.regexp_replace(s["value"], drop, "")
    email = _spans(text, "@", _EMAIL, "email")
    ip = F.filter(_spans(text, r"[0-9]\.[0-9]", _IP, "ip"), lambda s: s["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(
        _spans(text, r"[0-9](?:[\x20-]?[0-9]){12}", _CARD, "card"),
        lambda s: F.length(digits(s, "[ -]")).between(13, 19) & F.call_function("luhn_check", digits(s, "[ -]")),
    )
    phone = F.filter(_spans(text, r"\+[0-9]", _PHONE, "phone"), lambda s: F.length(digits(s, "[^0-9]")).between(9, 15))
    return F.concat(email, ip, card, phone)


def _tokens(text: Column) -> Column:
    """Identifier-like tokens (those with a digit or @) from their first such character, with what stands before each, back to the last one."""
    item = lambda gap, value, start, at: F.struct(start.alias("start"), value.alias("value"), F.reverse(F.concat(F.when(at > 0, "# ").otherwise(""), gap)).alias("before"))
    return F.when(text.rlike("[0-9@]"), _folded(text, r"\G([^0-9@]*+)([0-9@]\S*+)", _TOKEN, item)).otherwise(F.expr(f"cast(array() as {_TOKEN})"))


def candidates(text: Column, base: Column) -> Column:
    """array of (start, end, instance, one, two, seed): tokens with their pattern hashes; seed if a base span meets them."""

    # What stands before a token is held back to front, so each expression is anchored and reads no more than it takes.
    back = lambda t, n: F.reverse(F.regexp_extract(t["before"], r"^(\S*+)\s*+(\S*+)\s*+(\S*+)", n))

    def headed(t: Column) -> Column:
        head = back(t, 1)
        return F.struct((t["start"] - F.length(head)).alias("start"), F.concat(head, t["value"]).alias("value"), F.array(back(t, 3), back(t, 2)).alias("words"))

    def trimmed(t: Column) -> Column:
        lead = F.length(F.regexp_extract(t["value"], r"^([^\p{L}\p{N}+@]*+)", 1))
        tail = F.length(F.regexp_extract(F.reverse(t["value"]), r"^([^\p{L}\p{N}]*+)", 1))
        core = F.substring(t["value"], lead + 1, F.greatest(F.length(t["value"]) - lead - tail, F.lit(0)))
        return F.struct((t["start"] + lead).alias("start"), core.alias("core"), t["words"].alias("words"))

    def hashed(t: Column) -> Column:
        one, two = (F.lower(F.coalesce(F.try_element_at(t["words"], F.lit(-i)), F.lit(""))) for i in (1, 2))
        return F.struct(
            t["start"].alias("start"),
            (t["start"] + F.length(t["core"])).alias("end"),
            F.xxhash64(F.lower(t["core"])).alias("instance"),
            F.when(one != "", F.xxhash64(one)).alias("one"),
            F.when(two != "", F.xxhash64(two, one)).alias("two"),
            (F.length(F.regexp_replace(t["core"], "[^0-9]", "")) >= DIGITS).alias("like"),
        )

    def met(c: Column) -> Column:
        first = F.get(F.filter(base, lambda s: (s["start"] < c["end"]) & (s["end"] > c["start"])), F.lit(0))
        return F.struct(c.alias("c"), first.alias("span"))

    def judged(x: Column) -> Column:
        """A seed is its base span; only the token in which the span begins has its context."""
        c, span = x["c"], x["span"]
        begins = span.isNull() | (span["start"] >= c["start"])
        return F.struct(
            *[c[k].alias(k) for k in ("start", "end", "like")],
            F.when(span.isNull(), c["instance"]).otherwise(F.xxhash64(F.lower(span["value"]))).alias("instance"),
            *[F.when(begins, c[k]).alias(k) for k in ("one", "two")],
            span.isNotNull().alias("seed"),
        )

    out = _tokens(text)
    for step in (headed, trimmed, hashed, met, judged):
        out = F.transform(out, step)
    return F.filter(out, lambda c: c["seed"] | c["like"])


def _graph(rows: DataFrame) -> DataFrame:
    """(pattern, instance, seed, n) of a table with `candidates`."""
    c = rows.select(F.explode("candidates").alias("c"))
    return c.select(F.explode(F.array("c.one", "c.two")).alias("pattern"), "c.instance", "c.seed").where("pattern is not null").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))


def confident(rows: DataFrame) -> DataFrame:
    """(pattern, confidence): the patterns that are admitted once a round admits no more.

    Scores and confidences only grow from round to round, so the rounds end by themselves.
    """
    edges = stored(_graph(rows), "pii-graph")
    score = edges.where("seed").select("instance").distinct().withColumn("score", F.lit(1.0))
    best, last, admitted = None, None, -1
    while True:
        known = edges.join(score, "instance", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        support = F.count_if(F.col("score") >= CONFIDENCE)
        ranked = known.groupBy("pattern").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("confidence"), support.alias("support"))
        best = stored(ranked.where((F.col("support") >= SEEDS) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence"), "pii-confident")
        count = best.count()
        if last is not None:
            discard(*last)
        if count == admitted:
            discard(edges)
            return best
        admitted = count
        doubt = F.log1p(-F.least(F.col("confidence"), F.lit(0.999)))
        new = edges.where("not seed").join(best, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(doubt))).alias("score"))
        last = [best]
        score = stored(edges.where("seed").select("instance", F.lit(1.0).alias("score")).unionByName(new).groupBy("instance").agg(F.max("score").alias("score")), "pii-instances")


def extracted(docs: DataFrame) -> DataFrame:
    """row, doc_id, base, candidates: narrow, one row per row of docs; stored once."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = base.select("doc_id", "base", candidates(F.col("text"), F.col("base")).alias("candidates"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "pii-rows")


def _other(candidate: Column, base: Column | None = None) -> Column:
    return F.struct(F.lit("other").alias("kind"), candidate["start"].alias("start"), candidate["end"].alias("end"))


def found(docs: DataFrame) -> DataFrame:
    """doc_id, base (array of kind, start, end, value), other (array of kind, start, end)."""
    prepare(docs.sparkSession)
    rows = extracted(docs)
    best = confident(rows)
    loose = rows.select("row", F.explode("candidates").alias("c")).where("not c.seed")
    hits = loose.select("row", "c", F.explode(F.array("c.one", "c.two")).alias("pattern")).join(best, "pattern", "left_semi")
    other = hits.groupBy("row").agg(F.array_sort(F.collect_set(_other(F.col("c")))).alias("other"))
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    return rows.select("row", "doc_id", "base").join(other, "row", "left").select("doc_id", "base", F.coalesce("other", none).alias("other"))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets, e.g. [EMAIL]; a null text stays null."""
    prepare(docs.sparkSession)
    best = confident(extracted(docs)).select("pattern")
    text = F.coalesce("text", F.lit(""))
    base, loose, other, key = (free(docs, n) for n in ("base", "loose", "other", "key"))
    rows = docs.withColumn(base, base_spans(text)).withColumn(loose, F.filter(candidates(text, F.col(base)), lambda c: ~c["seed"]))
    # Equal texts have equal spans. Only texts with a token that a pattern may claim are joined, and so moved.
    some, of_text = F.size(loose) > 0, F.sha2("text", 256)
    tokens = rows.where(some).select(of_text.alias(key), F.explode(loose).alias("c")).distinct()
    hits = tokens.select(key, "c", F.explode(F.array("c.one", "c.two")).alias("pattern")).join(best, "pattern", "left_semi")
    claimed = stored(hits.groupBy(key).agg(F.collect_set(_other(F.col("c"))).alias(other)), "pii-other")
    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int>>)")
    joined = rows.where(some).withColumn(key, of_text).join(claimed, key, "left").withColumn(other, F.coalesce(other, none))
    rows = rows.where(~some).withColumn(other, none).drop(loose).unionByName(joined.drop(key, loose))
    spans = F.array_sort(F.transform(F.concat(_bare(F.col(base)), F.col(other)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def step(acc: Column, s: Column) -> Column:
        tag = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        inside = s["start"] < acc["at"]
        piece = F.concat(F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), tag)
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], piece)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    new = F.aggregate(spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    return rows.withColumn("text", F.when(F.col("text").isNull() | (F.size(spans) == 0), F.col("text")).otherwise(new)).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    """The rows of query op3."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = joined(F.col("base"))
    return found(docs).select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(base, 256).alias("base_sha256"), joined(F.concat(_bare(F.col("base")), F.col("other"))).alias("spans"))
