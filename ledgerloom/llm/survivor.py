"""One surviving record per duplicate group, by a stated order or by token-level consensus.

In ``best_records`` the order of whole values (votes, then day, then text) decides alone.  In ``consensus_names`` the spellings
of a group are aligned progressively, heaviest first; every column of the alignment is decided by the weights of its tokens, and
the existing spelling closest to that consensus survives, so many light spellings can outvote a heavy one token by token.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ledgerloom.operators.skew import checked_join, spread

#: Values that a task aligns in one piece; a group of more is dealt over parts, whose results are aligned again.
BLOCK = 300

# Words that stand in for a name; a text of nothing else (signs and digits aside) names nobody.
STAND_IN_WORDS = (
    "n a na none nil null tbc tba tbd various unknown supplier suppliers name names withheld see remittance remittances not known missing redacted misc miscellaneous payee payees sundry sundries creditor "
    "creditors do use vendor vendors anonymous unnamed blank test dummy individual private personal data information confidential applicable available invoice cash multiple other others the of to be confirmed"
).split()

_POSTCODE = r"^([A-Z]{1,2}[0-9][A-Z0-9]?)([0-9][A-Z]{2})$"


def names_somebody(name: Column) -> Column:
    """Whether a text names somebody: not NULL, blank, mere signs or digits, or only words standing in for a name."""
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}]+", " ")), " ")
    real = F.exists(words, lambda w: (w != "") & ~w.isin(*STAND_IN_WORDS) & ~w.rlike(r"^(.)\1*$"))
    return F.coalesce(real, F.lit(False))


def tidy_postcode(postcode: Column) -> Column:
    """A well-formed postcode in capitals with one space before its last three characters, NULL for any other text."""
    squeezed = F.upper(F.regexp_replace(postcode, r"[\s\u00a0]+", ""))
    return F.when(squeezed.rlike(_POSTCODE), F.regexp_replace(squeezed, _POSTCODE, "$1 $2"))


def tokens_of(value: Column) -> Column:
    """A value in capitals, its words parted by single blanks, signs left out."""
    return F.trim(F.regexp_replace(F.upper(value), r"[\s\p{Punct}]+", " "))


Profile = list[dict[str, float]]


@lru_cache(maxsize=200_000)
def likeness(a: str, b: str) -> float:
    """Share of letters that two tokens have in common in order, by edit distance."""
    if a == b:
        return 1.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


def aligned(one: Profile, other: Profile) -> Profile:
    """Two profiles (weights of tokens per column, '' for a gap) as one, by global alignment; the weights of a column add up."""
    n, m = len(one), len(other)
    of_one, of_other = (sum(p[0].values()) if p else 0.0 for p in (one, other))
    scale = (of_one or 1.0) * (of_other or 1.0)
    fit = [[sum(u * v * likeness(s, t) for s, u in a.items() if s for t, v in b.items() if t) / scale for b in other] for a in one]
    score = [[-0.5 * (i + j) if not i or not j else 0.0 for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            score[i][j] = max(score[i - 1][j - 1] + 2 * fit[i - 1][j - 1] - 0.7, score[i - 1][j] - 0.5, score[i][j - 1] - 0.5)
    merged, i, j = [], n, m
    while i or j:
        if i and j and score[i][j] == score[i - 1][j - 1] + 2 * fit[i - 1][j - 1] - 0.7:
            i, j = i - 1, j - 1
            merged.append({t: one[i].get(t, 0.0) + other[j].get(t, 0.0) for t in (*one[i], *other[j])})
        elif i and score[i][j] == score[i - 1][j] - 0.5:
            i -= 1
            merged.append({**one[i], "": one[i].get("", 0.0) + of_other})
        else:
            j -= 1
            merged.append({**other[j], "": other[j].get("", 0.0) + of_one})
    return merged[::-1]


def profile(spellings: Sequence[tuple[list[str], float]]) -> Profile:
    """The profile of tokenised spellings, aligned from the heaviest to the lightest."""
    out: Profile = []
    for k, (tokens, weight) in enumerate(sorted(spellings, key=lambda s: (-s[1], s[0]))):
        own = [{t: weight} for t in tokens]
        out = aligned(out, own) if k else own
    return out


def winners(columns: Profile) -> list[str]:
    """The token of most weight in each column, the smaller on a tie, gaps left out."""
    return [t for t in (min(c.items(), key=lambda kv: (-kv[1], kv[0]))[0] for c in columns) if t]


def consensus(spellings: Sequence[tuple[list[str], float]]) -> list[str]:
    """Tokens of the weighted consensus of tokenised spellings."""
    return winners(profile(spellings))


def in_parts(level: DataFrame, keys: list[str], fields: list[str], value: str, merge: Callable[[list[tuple]], tuple]) -> DataFrame:
    """``level`` (``keys`` and ``fields``) with each group merged to one row, a large group part by part until one part is left.

    ``merge`` makes the fields of one row of the entries of a part, which come sorted by ``fields``.  Groups are counted before
    they are brought together; one of more than ``BLOCK`` rows is dealt over parts by ``value``.
    """
    shape = level.select(*keys, *fields).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape)
    arrow = [to_arrow_type(f.dataType) for f in shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [merge([tuple(e.values()) for e in entries]) for entries in batch.column(len(keys)).to_pylist()]
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(arrow[len(keys) :])]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], *made], names=shape.names)

    while True:
        sizes = level.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        hot = sizes.where(F.col("_n") > BLOCK).select(*keys, F.ceil(F.col("_n") * 2 / F.lit(BLOCK)).cast("int").alias("_parts"))
        many = hot.limit(1).count() > 0
        dealt = checked_join(level, hot, keys, "left").fillna({"_parts": 1}).withColumn("_part", spread(F.col(value), F.col("_parts"))) if many else level.withColumn("_part", F.lit(0))
        level = dealt.groupBy(*keys, "_part").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_entries")).select(*keys, "_entries").mapInArrow(run, kinds)
        if not many:
            return level


def closest_to_consensus(entries: list[tuple]) -> tuple:
    """Of entries (-votes, -day, value, tokens) in order, the one whose tokens are closest to the consensus; the first on a tie.

    An entry's weight is a quarter of that of the one before it, so that it outweighs all behind it together; the first therefore
    always wins.  No query runs this: it shows that a consensus under the ranks of ``best_records`` is its rule.
    """
    if len({e[3] for e in entries}) == 1:
        return entries[0]
    found = " ".join(consensus([(e[3].split(), 0.25**k) for k, e in enumerate(entries)]))
    return max(entries, key=lambda e: likeness(e[3], found))


def best_records(records: DataFrame) -> DataFrame:
    """(supplier_key, supplier_name_raw, postcode), one row per key with at least two distinct rows.

    Spellings that name somebody are ranked by the sum of their rows_n (NULL is 0), then the latest last_payment (NULL is
    earliest), then the smallest text; well-formed postcodes by the latest last_payment, then the rows_n there, then the smallest
    text.  Each survivor is the first of its field; the name is NULL if no spelling names somebody, the postcode '' if none is
    well-formed.  Identical rows count once, a NULL key is no group.  Values are counted before their keys are brought together,
    and the first of a group is taken in part before it is gathered.
    """
    columns = ["supplier_key", "supplier_name_raw", "rows_n", "last_payment", "postcode", *[c for c in ("entity", "company_number") if c in records.columns]]
    rows = records.where("supplier_key IS NOT NULL").select(*columns).distinct()
    day, votes, code = F.coalesce(F.unix_date("last_payment"), F.lit(-10_000_000)).cast("bigint"), F.coalesce("rows_n", F.lit(0)).cast("bigint"), tidy_postcode(F.col("postcode"))
    counted = rows.groupBy("supplier_key", "supplier_name_raw", code.alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum(votes).alias("votes"), F.max(day).alias("day"), F.max(F.struct(day.alias("day"), votes.alias("votes"))).alias("last"))
    counted = counted.persist(StorageLevel.MEMORY_AND_DISK)
    name = F.col("supplier_name_raw")
    names = counted.where(names_somebody(name)).groupBy("supplier_key", name.alias("value")).agg(F.sum("votes").alias("first"), F.max("day").alias("second"))
    codes = counted.where("code IS NOT NULL").groupBy("supplier_key", F.col("code").alias("value")).agg(F.max("last").alias("l")).select("supplier_key", "value", F.col("l.day").alias("first"), F.col("l.votes").alias("second"))
    level = names.withColumn("field", F.lit("name")).unionByName(codes.withColumn("field", F.lit("code"))).select("supplier_key", "field", (-F.col("first")).alias("a"), (-F.col("second")).alias("b"), "value")
    best = level.groupBy("supplier_key", "field").agg(F.min(F.struct("a", "b", "value")).alias("f")).select("supplier_key", "field", "f.value")
    size = counted.groupBy("supplier_key").agg(F.sum("n").alias("n"))
    both = best.select("supplier_key", "field", "value", F.lit(0).cast("bigint").alias("n")).unionByName(size.select("supplier_key", F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value"), "n"))
    of = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    out = both.groupBy("supplier_key").agg(F.sum("n").alias("n"), of("name").alias("supplier_name_raw"), F.coalesce(of("code"), F.lit("")).alias("postcode"))
    return out.where("n > 1").select("supplier_key", "supplier_name_raw", "postcode")


def merged_profiles(entries: list[tuple]) -> tuple:
    """Of entries (-weight, profile in JSON) in order, their sum of weights and their one profile."""
    out, weight = json.loads(entries[0][1]), entries[0][0]
    for less, text in entries[1:]:
        out, weight = aligned(out, json.loads(text)), weight + less
    return weight, json.dumps(out)


def consensus_names(records: DataFrame) -> DataFrame:
    """(supplier_key, consensus, supplier_name_raw): the token consensus of each key's spellings and the spelling closest to it.

    Weights are the sums of rows_n plus one per row.  Spellings that name nobody and NULL keys take no part; identical
    rows count once.  Closeness is the edit distance of the folded texts, then the weight, then the smaller text.  Profiles
    keep every token's votes, so a group that is aligned in parts loses none when its parts are aligned with each other.
    """
    rows = records.where(F.col("supplier_key").isNotNull() & names_somebody(F.col("supplier_name_raw"))).distinct()
    votes = rows.groupBy("supplier_key", "supplier_name_raw").agg((F.sum(F.coalesce("rows_n", F.lit(0))) + F.count(F.lit(1))).cast("double").alias("weight"))
    tokens = tokens_of(F.col("supplier_name_raw"))
    level = votes.groupBy("supplier_key", tokens.alias("tokens")).agg(F.sum("weight").alias("weight"))
    single = F.to_json(F.transform(F.split("tokens", " "), lambda t: F.create_map(t, F.col("weight"))))
    merged = in_parts(level.select("supplier_key", (-F.col("weight")).alias("less"), single.alias("profile")), ["supplier_key"], ["less", "profile"], "profile", merged_profiles)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(winners(json.loads(p))) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["supplier_key", "consensus"])

    best = merged.select("supplier_key", "profile").mapInArrow(decide, "supplier_key string, consensus string")
    scored = checked_join(votes, best, ["supplier_key"]).withColumn("_far", F.levenshtein(tokens, F.col("consensus")))
    choice = scored.groupBy("supplier_key").agg(F.min(F.struct("_far", (-F.col("weight")).alias("w"), "supplier_name_raw")).alias("_b"), F.min("consensus").alias("consensus"))
    return choice.select("supplier_key", "consensus", F.col("_b.supplier_name_raw").alias("supplier_name_raw"))
