"""Benchmark decontamination by template canonicalisation.

Tokens are numbers, words and sentence marks. Numbers, units after a number, and names (a capital inside a sentence) become
typed placeholders, all else lower case; sentence marks are dropped. A capital that opens a sentence may be a name or not, so
such a token is both: it meets any name and any other opening capital as a placeholder, and its own word in lower case. A window
has a hash for each reading of its opening tokens. Windows of ``WINDOW`` template tokens of the benchmark
are hash-joined with the windows of all documents, but for those of which a half can meet no half of the benchmark
(a bitmap of bounded size tells). Windows of one item at one distance form an alignment.
Its slots are the typed tokens of the item; a slot value is torn if it has several counterparts in the document. A window counts
if none of its slots is changed, or if none of its slot values is torn. So a question with other numbers or names is found, an exact
copy in part is found whatever is beside it, and a mere likeness of form is not.

A document is contaminated by an item if the windows that count cover ``LEAST_WINDOWS`` windows of the item
or ``LEAST_SHARE`` of them. DataFrame expressions only.

Defined results: null and empty texts match nothing; items shorter than a window match where a
document holds all their tokens in a row, case aside, without any changed slot, and those of fewer than ``LEAST_WORDS`` words (numbers, units
and names inside a sentence are none) match only documents that consist of these tokens; items with equal templates and slots are reported each; documents that are equal in id and
text are reported once; an empty benchmark or table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

WINDOW = 8
HALF = WINDOW // 2
LEAST_WINDOWS = 6
LEAST_SHARE = 0.5
#: Words from which an item that is shorter than a window counts inside a longer text.
LEAST_WORDS = 3
#: Bits of the test for what the benchmark holds, at most.
MOST_BITS = 1 << 21
#: Windows of a document that are hashed at once: a task holds the readings of so many, whatever the length of the text.
CHUNK = 256

#: Words that are units when they follow a number.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons tonnes ounce ounces pound pounds lb lbs "
    "ml l litre litres liter liters gallon gallons second seconds minute minutes hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros percent degrees"
).split()

Test = Callable[[Column], Column]
_TOKEN = r"[0-9]+(?:[.,][0-9]+)*|[\p{L}\p{N}]+|[.!?\n]"


def _kind(name: str) -> Column:
    """The hash that stands for a placeholder in a template: num, unit, name, or open for a capital that opens a sentence."""
    return F.xxhash64(F.lit(f"<{name}>"))


def _typed(tokens: Column, token: Column, i: Column, a_word: Test) -> Column:
    """Template token: the hash of its canonical form, or null for a sentence mark. Comparisons with a sign after the last digit or letter tell the first character."""
    before = F.get(tokens, i - 1)
    unit = (before >= "0") & (before < ":") & F.lower(token).isin(*UNITS)
    word = F.when(unit, _kind("unit")).otherwise(F.xxhash64(F.lower(token)))
    first = F.substring(token, 1, 1)
    inside = (i > 0) & ~before.isin(".", "!", "?", "\n")
    capital = F.when(inside | ~a_word(F.xxhash64(F.lower(token))), _kind("name")).otherwise(_kind("open"))
    return (
        F.when((token >= "a") & (token < "{"), word)
        .when((token < "0") | (token == "?"), None)
        .when(token < ":", _kind("num"))
        .when(unit, _kind("unit"))
        .when(F.lower(first) != first, capital)
        .otherwise(F.xxhash64(F.lower(token)))
    )


def with_template(df: DataFrame, a_word: Test = lambda key: F.lit(True)) -> DataFrame:
    """Add raw (tokens without marks) and template (hashes of their canonical form). An opening token that cannot be a word of the benchmark is a name."""
    return (
        df.withColumn("_tokens", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_TOKEN), F.lit(0)))
        .withColumn("raw", F.filter("_tokens", lambda t: (t >= "0") & (t != "?")))
        .withColumn("template", F.filter(F.transform("_tokens", lambda t, i: _typed(F.col("_tokens"), t, i, a_word)), lambda t: t.isNotNull()))
        .drop("_tokens")
    )


def _no_places() -> Column:
    return F.array().cast("array<int>")


def _chunks(df: DataFrame, *keep: str) -> DataFrame:
    """Pieces of CHUNK places: start, and the raw and template of their tokens and of those that the last windows reach into."""
    piece = lambda c, s: F.slice(c, s + 1, CHUNK + WINDOW - 1).alias(c)
    # no filter on a computed array: Spark would push it below the array and tokenise once more per token
    starts = F.when(F.size("template") > 0, F.sequence(F.lit(0), F.size("template") - 1, F.lit(CHUNK))).otherwise(_no_places())
    pieces = F.transform(starts, lambda s: F.struct(s.alias("start"), piece("raw", s), piece("template", s)))
    return df.select(*keep, F.explode(pieces).alias("_piece")).select(*keep, "_piece.*")


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """A value that a lambda uses often is worked out once."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _half_hash(tokens: Sequence[Column]) -> Column:
    return F.xxhash64(F.lit(HALF), *tokens)


def _word(i: Column) -> Column:
    return F.xxhash64(F.lower(F.get("raw", i)))


def _half(i: Column) -> Column:
    """The readings of the half window at i: hash, and lits (bits of the opening tokens read as words)."""

    def reading(lits: Column) -> Column:
        tokens = []
        for k in range(HALF):
            t = F.get("template", i + k)
            tokens.append(F.when(t != _kind("open"), t).when(lits.bitwiseAND(1 << k) != 0, _word(i + k)).otherwise(_kind("name")))
        return F.struct(_half_hash(tokens).alias("hash"), lits.alias("lits"))

    bits = F.lit(0)
    for k in range(HALF):
        bits = bits + F.when(F.get("template", i + k) == _kind("open"), 1 << k).otherwise(0)
    # the sets of opening tokens that may be words, for each set of opening tokens
    sets = F.array(*[F.array(*[F.lit(m) for m in range(1 << HALF) if m & b == m]) for b in range(1 << HALF)])
    return F.transform(F.get(sets, bits), reading)


def _fits(size: int, most: int) -> Column:
    """Places of a piece, up to the given one, at which so many tokens begin."""
    return F.when(F.size("template") >= size, F.sequence(F.lit(0), F.least(F.lit(most), F.size("template") - size))).otherwise(_no_places())


def _readings(sizes: Sequence[int], open_known: Test, known: Test) -> Column:
    """All windows of a piece in all readings whose halves pass the tests: size, place in the piece, hash, and lits.

    Below the full size a window has one reading, its raw tokens in lower case, and is tested as a whole."""
    window = lambda size, at, key, lits: F.struct(F.lit(size).alias("size"), at.alias("at"), key.alias("hash"), lits.alias("lits"))

    def whole(i: Column) -> Column:
        kept = lambda j: F.filter(_half(j), lambda h: known(h["hash"]))
        joined = lambda a, b: window(WINDOW, i, F.xxhash64(a["hash"], b["hash"]), a["lits"] + b["lits"] * (1 << HALF))
        return F.flatten(F.transform(kept(i), lambda a: F.transform(kept(i + HALF), lambda b: joined(a, b))))

    def short(size: int) -> Column:
        tokens = lambda i: F.xxhash64(F.lit(size), *[F.lower(F.get("raw", i + k)) for k in range(size)])
        return F.filter(F.transform(_fits(size, CHUNK - 1), lambda i: window(size, i, tokens(i), F.lit(0))), lambda w: known(w["hash"]))

    # one hash per place with opening tokens left open tells where readings are worth while
    open_halves = F.transform(_fits(HALF, CHUNK - 1 + HALF), lambda i: _half_hash([F.get("template", i + k) for k in range(HALF)]))
    passes = F.transform(open_halves, open_known)
    places = _once(passes, lambda p: F.filter(_fits(WINDOW, CHUNK - 1), lambda i: F.get(p, i) & F.get(p, i + HALF)))
    return F.concat(*[F.flatten(F.transform(places, whole)) if size == WINDOW else short(size) for size in sizes])


def _windows(df: DataFrame, sizes: Sequence[int], open_known: Test, known: Test, *keep: str) -> DataFrame:
    """Each reading of each window that passes the tests: the columns to keep, size, at, hash, lits, and the raw and template tokens of the window."""
    shown = _chunks(df, *keep).select(*keep, "start", "raw", "template", F.explode(_readings(sizes, open_known, known)).alias("_window"))
    tokens = lambda c: F.expr(f"slice({c}, _window.at + 1, _window.size)")
    return shown.select(
        *keep, "_window.size", (F.col("start") + F.col("_window.at")).alias("at"), "_window.hash", "_window.lits", tokens("raw").alias("words"), tokens("template").alias("types")
    )


def _bench_windows(items: DataFrame) -> DataFrame:
    """item_id, size of the windows, number of windows, whether the item has too few words, place, hash, reading, raw tokens and slots of each window."""
    words = F.size(F.filter("template", lambda t: ~t.isin(_kind("num"), _kind("unit"), _kind("name"))))
    items = items.withColumn("of", F.least(F.size("template"), F.lit(WINDOW)))
    items = items.withColumn("n", F.size("template") - F.col("of") + 1).withColumn("few", (F.col("of") < WINDOW) & (words < LEAST_WORDS))
    every = _windows(items, range(1, WINDOW + 1), lambda h: F.lit(True), lambda h: F.lit(True), "item_id", "of", "n", "few").where("size = of")
    slots = F.transform("types", lambda t: t.isin(*[_kind(k) for k in ("num", "unit", "name", "open")]))
    return every.select("item_id", "size", "n", "few", F.col("at").alias("place"), "hash", F.col("lits").alias("item_lits"), F.col("words").alias("item_raw"), slots.alias("item_slots"))


def _meets(i: Column) -> Column:
    """The hashes of all halves of documents that the half at i of an item may meet, with opening tokens left open or read."""

    def options(at: Column) -> Column:
        t = F.get("template", at)
        fixed = F.when(t.isin(_kind("num"), _kind("unit")), F.array(t))
        return fixed.when(t == _kind("open"), F.array(t, _kind("name"), _word(at))).otherwise(F.array(t, _kind("open")))

    def choose(chosen: list[Column], k: int) -> Column:
        if k == HALF:
            return F.array(_half_hash(chosen))
        return F.flatten(F.transform(options(i + k), lambda t: choose([*chosen, t], k + 1)))

    return choose([], 0)


def _tests(items: DataFrame, windows: DataFrame) -> tuple[Test, Test]:
    """Two tests: for halves with opening tokens left open that may meet the benchmark, and for its own halves and short windows."""
    places = F.when(F.size("template") >= WINDOW, F.sequence(F.lit(0), F.size("template") - HALF)).otherwise(_no_places())
    halves = cut(items.select("raw", "template", F.explode(places).alias("_at")), "bench-halves")
    meets = halves.select(F.explode(_meets(F.col("_at"))).alias("hash"))
    own = halves.select(F.explode(_half(F.col("_at"))).alias("_half")).select("_half.hash").unionByName(windows.where(F.col("size") < WINDOW).select("hash"))
    return _bitmap(meets), _bitmap(own)


def _bitmap(hashes: DataFrame) -> Test:
    """A test that all these hashes pass, and most others fail: one bit per hash.

    Texts that share nothing with the benchmark make next to no rows. The test has MOST_BITS bits at most, however large the
    benchmark: beyond a sixteenth as many hashes it lets more through, and never stops what may meet the benchmark.
    """
    keys = cut(hashes.distinct(), "bench-keys")
    bits = min(MOST_BITS, 1 << max(10, (16 * keys.count()).bit_length()))
    place = F.col("hash").bitwiseAND(bits - 1)
    word = F.call_function("shiftright", place, F.lit(6)).cast("int")
    marks = keys.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("mark"))
    words = [0] * (bits // 64)
    for row in marks.groupBy("word").agg(F.bit_or("mark").alias("marks")).collect():  # MOST_BITS / 64 rows at most
        words[row["word"]] = row["marks"]
    # a constant: Spark folds it into one array
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")

    def known(key: Column) -> Column:
        mark = F.get(table, F.call_function("shiftright", key.bitwiseAND(bits - 1), F.lit(6)).cast("int"))
        return F.call_function("shiftright", mark, key.bitwiseAND(63).cast("int")).bitwiseAND(1) == 1

    return known


def matches(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """Every window that a document shares with an item, with the tokens of both."""
    items = cut(with_template(bench.select("item_id", "text")), "bench-items")
    windows = cut(_bench_windows(items), "bench-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # WINDOW rows at most
    a_word = _bitmap(items.select(F.explode("raw").alias("_word")).select(F.xxhash64(F.lower("_word")).alias("hash")))
    keyed = with_template(docs.select("doc_id", "text"), a_word).withColumn("digest", F.xxhash64("text")).withColumn("tokens", F.size("raw"))
    # the texts are tokenised once; their windows that may meet the benchmark are written, and meet it in one join
    shown = cut(_windows(keyed, sorted(sizes) or [WINDOW], *_tests(items, windows), "doc_id", "digest", "tokens").drop("types"), "bench-candidates")
    # two opening tokens meet as names, so that a pair of windows comes once
    once = F.col("lits").bitwiseAND(F.col("item_lits")) == 0
    return shown.join(windows, ["size", "hash"]).where(once & (~F.col("few") | (F.col("tokens") == F.col("size")))).select(
        "doc_id", "digest", "item_id", "n", "place", "at", "item_raw", "item_slots", F.col("words").alias("doc_raw")
    )


def contaminated(docs: DataFrame, bench: DataFrame, least_windows: int = LEAST_WINDOWS, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, digest of its text, item_id, n_windows, share of the item's windows, and n_changed slots."""
    found = cut(matches(docs, bench), "bench-matches")
    # only typed tokens that differ are slots with another value; case alone is no other value
    pairs = F.filter(F.arrays_zip(F.col("item_raw").alias("old"), F.col("doc_raw").alias("new"), F.col("item_slots").alias("slot")), lambda p: p["slot"])
    keys = ["doc_id", "digest", "item_id", "shift"]
    slots = found.select(
        "doc_id", "digest", "item_id", (F.col("at") - F.col("place")).alias("shift"), "n", "place",
        F.transform(pairs, lambda p: F.struct(F.lower(p["old"]).alias("old"), F.lower(p["new"]).alias("new"))).alias("slots"),
    )
    torn = (
        slots.select(*keys, F.explode("slots").alias("slot"))
        .groupBy(*keys, "slot.old")
        .agg(F.min("slot.new").alias("least"), F.max("slot.new").alias("most"))
        .where("least <> most")
        .groupBy(*keys)
        .agg(F.collect_set("old").alias("torn"))
    )
    even = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    changed = F.array_distinct(F.transform(F.filter("slots", lambda p: p["old"] != p["new"]), lambda p: p["old"]))
    values = F.transform("slots", lambda p: p["old"])
    counted = (
        slots.alias("l")
        .join(torn.alias("r"), even[0] & even[1] & even[2] & even[3], "left")
        .select(*[f"l.{k}" for k in keys], "n", "place", changed.alias("changed"), values.alias("values"), "torn")
        .where((F.size("changed") == 0) | F.col("torn").isNull() | ~F.arrays_overlap("values", "torn"))
    )
    # an alignment has no more windows than its item
    return (
        counted.groupBy(*keys, "n")
        .agg(F.collect_set("place").alias("places"), F.size(F.array_distinct(F.flatten(F.collect_set("changed")))).cast("long").alias("changed"))
        .select("doc_id", "digest", "item_id", "n", "changed", F.explode("places").alias("place"))
        .groupBy("doc_id", "digest", "item_id", "n")
        .agg(F.count_distinct("place").alias("n_windows"), F.max("changed").alias("n_changed"))
        .withColumn("share", F.col("n_windows") / F.col("n"))
        .where((F.col("n_windows") >= least_windows) | (F.col("share") >= least_share))
        .select("doc_id", "digest", "item_id", "n_windows", "share", "n_changed")
    )


def drop_contaminated(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents that no benchmark item has leaked into, all columns as they were."""
    bad = contaminated(docs, bench).select(F.col("doc_id").alias("_bad_id"), F.col("digest").alias("_bad_digest")).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("_bad_id")) & (F.xxhash64(docs["text"]) == F.col("_bad_digest")), "left_anti")
