"""Column functions: ids, times, text classes, portable draws."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tweet-id clock: first id that carries a time, epoch in ms, bits below the time.
SNOWFLAKE_MIN, SNOWFLAKE_EPOCH_MS, SNOWFLAKE_SHIFT = 29_700_859_247, 1_288_834_974_657, 22
POST, REPLY, REPOST, LINK = 0, 1, 2, 3


def has_time(tweet_id: Column) -> Column:
    return tweet_id >= SNOWFLAKE_MIN


def id_time_ms(tweet_id: Column) -> Column:
    return F.shiftright(tweet_id, SNOWFLAKE_SHIFT) + SNOWFLAKE_EPOCH_MS


def hour_of_day(ts_ms: Column) -> Column:
    return F.floor(F.pmod(ts_ms, F.lit(86_400_000)) / 3_600_000)


def post_type(text: Column) -> Column:
    """0 plain or empty, 2 repost, 1 reply, 3 ends in a shortened link; the first that holds."""
    return (
        F.when(text.isNull() | (text == ""), POST)
        .when(text.rlike(r"(?U)^\s*RT\s+@\w+"), REPOST)
        .when(text.rlike(r"(?U)^\s*@\w+"), REPLY)
        .when(text.rlike(r"(?U)https?://t\.co/\w+\s*$"), LINK)
        .otherwise(POST)
    )


#: English stop words of the cleaning step (fixed values); those with an apostrophe can't occur after it.
STOP_WORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself she
she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll these
those am is are was were be been being have has had having do does did doing a an the and but if or because as until while
of at by for with about against between into through during before after above below to from up down in out on off over
under again further then once here there when where why how all any both each few more most other some such no nor not
only own same so than too very s t can will just don don't should should've now d ll m o re ve y ain aren aren't couldn
couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn
needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
""".split()


def cleaned_words(text: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower case; links, www, mentions, tags, non-ASCII and non-letters each become a blank; no stop words; single blanks."""
    steps = [r"http\S+|www\.\S+", r"(?U)[@#]\w+", r"[^\x00-\x7F]+", r"[^a-z\s]"]
    bare = reduce(lambda c, s: F.regexp_replace(c, s, " "), steps, F.lower(F.coalesce(text, F.lit(""))))
    words = F.filter(F.split(F.trim(F.regexp_replace(bare, r"\s+", " ")), " "), lambda w: (w != "") & ~w.isin(stop_words))
    return F.array_join(words, " ")


def parsed_time(text: Column) -> Column:
    """TIMESTAMP (UTC) of `Wed Oct 05 20:19:24 +0000 2011`, the same without zone, or `2011-10-05 20:19:24`; null otherwise."""
    bare = F.regexp_replace(F.trim(text), r"^[A-Za-z]{3} ", "")
    forms = ["MMM dd HH:mm:ss xx yyyy", "MMM dd HH:mm:ss yyyy", "yyyy-MM-dd HH:mm:ss"]
    return F.coalesce(*[F.try_to_timestamp(bare, F.lit(f)) for f in forms])


def days_since(created: Column, reference: str) -> Column:
    """Whole days from created to the reference date, 0 if later, missing or unreadable."""
    micros = F.unix_micros(F.lit(reference).cast("timestamp")) - F.unix_micros(created)
    return F.coalesce(F.greatest(F.floor(micros / 86_400_000_000), F.lit(0)), F.lit(0))


def draw(*parts: Column | str, seed: int) -> Column:
    """A portable pseudo-random number in [0, 1): the first 32 bits of an md5."""
    cols = [p if isinstance(p, Column) else F.col(p) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4_294_967_296.0


#: Rounds of the keyed permutation.
ROUNDS = 24


def permutation_keys(n: Column, *key: Column | str, seed: int, rounds: int = ROUNDS) -> Column:
    """ARRAY<STRUCT<r, k>>: the rounds' drawn K of a permutation; the same for all its places, so it can be worked out once."""
    return F.array(*[F.struct(F.lit(r).alias("r"), F.floor(draw(*key, F.lit(r), F.lit("k"), seed=seed) * n).cast("long").alias("k")) for r in range(1, rounds + 1)])


def permuted(i: Column, n: Column, *key: Column | str, seed: int, rounds: int = ROUNDS, keys: Column | None = None) -> Column:
    """The place of i (0 to n - 1) in a permutation of 0 to n - 1 that key and seed choose; no list of n is made.

    Swap-or-not shuffle: a round pairs i with K - i mod n for a drawn K and takes the partner if the larger of both draws so.
    keys: a column of permutation_keys of the same n, key and seed.
    """

    def step(at: Column, by: Column) -> Column:
        other = F.pmod(by["k"] - at, n)
        return F.when(draw(*key, by["r"], F.greatest(at, other), F.lit("s"), seed=seed) < 0.5, other).otherwise(at)

    return F.aggregate(permutation_keys(n, *key, seed=seed, rounds=rounds) if keys is None else keys, i.cast("long"), step)


def ratio(a: Column, b: Column, empty: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(empty))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
