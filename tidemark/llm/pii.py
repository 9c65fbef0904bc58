"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that fixed patterns find (e-mail, IP address, card number, phone number). The words around them are
lexical patterns. Other strings of an identifier's shape are candidates. Pattern and instance form a graph that is scored in
rounds: a pattern is as good as the trusted part of its distinct instances, an instance as good as its patterns together, so that
an instance which several good patterns surround strengthens the others it stands in;
patterns of high confidence and enough distinct instances then make candidates of a fitting shape identifiers. Counts are of
distinct instances, so copies of a document add nothing. DataFrame expressions only.

Defined results: null and empty texts hold nothing; offsets are code points, ends are exclusive; documents that are equal in
id and text get equal spans; spans found by the method never overlap those of the fixed patterns; an empty table gives no
rows; other columns are passed on by ``redact`` and not read elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern needs so much trust in its distinct instances of one kind, and such a part of all its instances in the end.
LEAST_SUPPORT, LEAST_CONFIDENCE = 4.0, 0.7
#: The part from which a pattern hands trust on to its instances between the rounds.
LEAST_SPREAD = 0.6
#: Code points of context that are looked at on either side.
CONTEXT = 60

# The fixed patterns match as the plain ones in the comments do; a start inside a run that cannot match is not tried.
_PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # [0-9]([\x20-]?[0-9])+ of 13 digits and more
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12}(?:[ -]?[0-9])*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_MAY_HAVE = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
_MAIL_LIKE = r"[^\s@]{1,64}+@[^\s@]{1,255}|[\w.+-]{1,64} ?[\[(]at[\])] ?[\w.-]{1,255}"
_IP_LIKE = r"(?<![0-9A-Za-z])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3,5}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7})(?![0-9A-Za-z])"
_NUMBER_LIKE = r"(?<![0-9A-Za-z])[+(]?[0-9][0-9 ()./-]{5,28}[0-9](?![0-9A-Za-z])"
_CANDIDATE = f"{_IP_LIKE}|{_NUMBER_LIKE}|{_MAIL_LIKE}"
_MAY_CANDIDATE = r"@|[\[(]at[\])]|[0-9A-Fa-f]:[0-9A-Fa-f:]|[0-9][0-9 ()./-]{5}"
_BLOCK = 256


def _add_hits(df: DataFrame, out: str, pattern: str, may: Column) -> DataFrame:
    """Add the leftmost non-overlapping matches as structs of first, last, hit, left and right.

    Places are running sums over the pieces between matches: first in blocks, then over blocks, so that a text with very
    many matches costs no square of their number.
    """
    text, p = F.when(may, F.col("text")).otherwise(F.lit("")), f"_{out}_"
    none = F.array().cast("array<int>")

    def running(lengths: Column, start: Column) -> Column:
        ends = F.aggregate(lengths, F.struct(start.alias("at"), none.alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"] + n).alias("out")))
        return ends["out"]

    block = lambda k: F.slice(p + "lengths", k * _BLOCK + 1, F.lit(_BLOCK))
    return (
        df.withColumn(p + "text", text)
        .withColumn(p + "hits", F.regexp_extract_all(p + "text", F.lit(pattern), F.lit(0)))
        .withColumn(p + "between", F.when(F.size(p + "hits") > 0, F.split(p + "text", pattern, -1)).otherwise(F.array(p + "text")))
        .withColumn(p + "lengths", F.transform(p + "hits", lambda h, i: F.length(F.get(p + "between", i)) + F.length(h)))
        .withColumn(p + "blocks", F.when(F.size(p + "lengths") > 0, F.sequence(F.lit(0), F.floor((F.size(p + "lengths") - 1) / _BLOCK).cast("int"))).otherwise(none))
        .withColumn(p + "sums", F.transform(p + "blocks", lambda k: F.aggregate(block(k), F.lit(0), lambda a, n: a + n)))
        .withColumn(p + "starts", F.concat(F.array(F.lit(0)), running(F.col(p + "sums"), F.lit(0))))
        .withColumn(p + "ends", F.flatten(F.transform(p + "blocks", lambda k: running(block(k), F.get(p + "starts", k)))))
        .withColumn(
            out,
            F.transform(
                p + "hits",
                lambda h, i: F.struct(
                    (F.get(p + "ends", i) - F.length(h)).alias("first"),
                    F.get(p + "ends", i).alias("last"),
                    h.alias("hit"),
                    F.right(F.get(p + "between", i), F.lit(CONTEXT)).alias("left"),
                    F.left(F.get(p + "between", i + 1), F.lit(CONTEXT)).alias("right"),
                ),
            ),
        )
        .drop(*[p + x for x in ("text", "hits", "between", "lengths", "blocks", "sums", "starts", "ends")])
    )


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int") <= 255, F.ltrim(p, F.lit("0")) == ""))
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _patterns(left: Column, right: Column) -> Column:
    """Two words before; and one word on either side. A pattern holds a letter at least."""
    plain = lambda c: F.lower(F.regexp_replace(c, "[0-9]", "0"))
    before = F.regexp_extract(plain(left), r"(\S*)\s*$", 1)
    two = F.regexp_extract(plain(left), r"(?:\S+\s+)?\S+\s*$", 0)
    after = F.regexp_extract(plain(right), r"^\s*(\S*)", 1)
    found = F.array(F.concat(F.lit("2|"), F.regexp_replace(F.trim(two), r"\s+", " ")), F.concat(F.lit("1|"), before, F.lit("|"), after))
    # signs alone say nothing of what they surround
    return F.filter(found, lambda p: p.rlike(r"\p{L}"))


def _fits(hit: Column) -> Column:
    """The kinds whose shape a candidate has."""
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    shape = {
        "email": hit.rlike(r"@|[\[(]at[\])]"),
        "ip": hit.rlike(f"^(?:{_IP_LIKE})$"),
        "card": hit.rlike(r"^[0-9 ./-]+$") & digits.between(13, 19),
        "phone": hit.rlike(r"^[0-9 ()+./-]+$") & digits.between(7, 15),
    }
    return F.array_compact(F.array(*[F.when(shape[k], F.lit(k)) for k in KINDS]))


def _validity(kind: str):
    return lambda s: _valid(kind, s["hit"])


def _seed(kind: str):
    return lambda s: F.struct(
        F.lit(kind).alias("kind"), s["first"], s["last"], F.xxhash64(F.lower(s["hit"])).alias("instance"), _patterns(s["left"], s["right"]).alias("patterns")
    )


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def _spans(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base spans and candidates of each document; texts are read once and not shuffled."""
    df = docs.select("doc_id", F.xxhash64("text").alias("digest"), F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        df = _add_hits(df, kind, _PATTERNS[kind], _MAY_HAVE[kind](F.col("text")))
    df = _add_hits(df, "other", _CANDIDATE, F.col("text").rlike(_MAY_CANDIDATE)).drop("text")
    base = F.concat(*[F.transform(F.filter(kind, _validity(kind)), _seed(kind)) for kind in KINDS])
    df = df.withColumn("base", base)
    other = F.filter("other", lambda o: ~F.exists("base", lambda b: (b["first"] < o["last"]) & (o["first"] < b["last"])))
    other = F.transform(
        other,
        lambda o: F.struct(
            o["first"], o["last"], F.xxhash64(F.lower(o["hit"])).alias("instance"), _fits(o["hit"]).alias("kinds"), _patterns(o["left"], o["right"]).alias("patterns")
        ),
    )
    return df.select("doc_id", "digest", "base", F.filter(other, lambda o: F.size(o["kinds"]) > 0).alias("other"))


def score_patterns(spans: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (instance, kind, trust) after some rounds over the graph."""
    seen = spans.select(F.explode("base").alias("s")).select("s.instance", F.array("s.kind").alias("kinds"), "s.patterns", F.col("s.kind").alias("seed"))
    new = spans.select(F.explode("other").alias("s")).select("s.instance", "s.kinds", "s.patterns", F.lit(None).cast("string").alias("seed"))
    edges = cut(seen.unionByName(new).select("instance", "kinds", "seed", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    seeds = edges.where("seed IS NOT NULL").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("trust")).distinct()
    totals = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("total"))
    links = edges.select("pattern", "instance", F.explode("kinds").alias("kind")).distinct()
    trusted = seeds
    for i in range(rounds):
        least = LEAST_CONFIDENCE if i == rounds - 1 else LEAST_SPREAD
        scored = links.join(trusted, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("trust").alias("support"))
        good = (
            scored.where(F.col("support") >= LEAST_SUPPORT)
            .join(totals, "pattern")
            .withColumn("confidence", F.col("support") / F.col("total"))
            .where(F.col("confidence") >= least)
            .select("pattern", "kind", "confidence")
        )
        good = cut(good, f"pii-patterns-{i}")
        doubt = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
        found = links.join(good, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - doubt).alias("trust"))
        trusted = found.where(F.col("trust") >= LEAST_SPREAD).unionByName(seeds).groupBy("instance", "kind").agg(F.max("trust").alias("trust"))
    return good, trusted


def find(docs: DataFrame) -> DataFrame:
    """doc_id, digest, base and added: sorted arrays of (kind number, first, last)."""
    spans = cut(_spans(docs), "pii-spans")
    good, _ = score_patterns(spans)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    added = (
        spans.select("doc_id", "digest", F.explode("other").alias("s"))
        .select("doc_id", "digest", "s.first", "s.last", F.explode("s.patterns").alias("pattern"), "s.kinds")
        .join(good, "pattern")
        .where(F.array_contains("kinds", F.col("kind")))
        .groupBy("doc_id", "digest", "first", "last")
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
        .agg(F.array_sort(F.collect_list(F.struct(number.alias("kind"), "first", "last"))).alias("added"))
    )
    numbered = lambda s: F.struct(
        (F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int") - 1).alias("kind"), s["first"], s["last"]
    )
    none = F.array().cast("array<struct<kind:int,first:int,last:int>>")
    return spans.join(added, spans["doc_id"].eqNullSafe(F.col("_id")) & (spans["digest"] == F.col("_digest")), "left").select(
        "doc_id", "digest", F.array_sort(F.transform("base", numbered)).alias("base"), F.coalesce("added", none).alias("added")
    )


def _text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["first"], s["last"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans as text."""
    found = find(docs)
    count = lambda k: F.size(F.filter("base", _of_kind(k))).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """All documents, with each span replaced by its kind in angle brackets; spans that overlap become the first one's kind."""
    found = find(docs).dropDuplicates(["doc_id", "digest"]).select(
        F.col("doc_id").alias("_id"),
        F.col("digest").alias("_digest"),
        F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["first"], s["last"], s["kind"]))).alias("_spans"),
    )
    found = found.where(F.size("_spans") > 0)
    text = F.col("text")
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        new = s["first"] >= a["at"]
        kept = F.substr(text, a["at"] + 1, s["first"] - a["at"])
        return F.struct(
            F.greatest(a["at"], s["last"]).alias("at"), F.when(new, F.concat(a["out"], F.array(kept, F.get(names, s["kind"])))).otherwise(a["out"]).alias("out")
        )

    masked = F.aggregate("_spans", start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["at"] + 1)))
    # one plan at every size: texts move once, and no table that grows with them is broadcast
    joined = docs.join(found.hint("merge"), docs["doc_id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_digest")), "left")
    return joined.select(*[F.when(F.col("_spans").isNull(), text).otherwise(masked).alias("text") if c == "text" else docs[c] for c in docs.columns])
