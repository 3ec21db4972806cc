"""Spellings of one payee, linked by an exact radius join of their distinctive words in a metric space.

Spellings that differ only in case, marks, legal form's writing, word order, usual short forms and the like share a key and are
one class.  Classes meet if they hold distinctive words within one edit (``metric.near_pairs``), and are linked if their
words pair off (``naming.same_payee``) and the postcodes on their lines don't speak against it.  Linked classes are joined to
components; spellings that fit several components (an initial, a cut end) go to one of them only if it is the sole one or
the only one with their postcode.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.metric import near_pairs
from ledgerloom.llm.naming import LEGAL_FORMS, Name, Vocabulary, composite_keys, fold, same_payee, vague, words
from ledgerloom.llm.survivor import tidy_postcode
from ledgerloom.operators.components import components, cut
from ledgerloom.operators.skew import checked_join, spread

#: A word is common if at least one spelling in so many holds it (and ``LEAST_COMMON`` do); there are at most some ten thousand of them.
COMMON_SHARE, LEAST_COMMON = 1500, 25
#: A short form or slip is resolved to a word that one spelling in so many holds.
STRONG_SHARE, LEAST_STRONG = 200, 30
#: Rows of one word that a task joins; a word of more is dealt over blocks that meet pair by pair.
BLOCK = 300
#: Words of so many letters may be two run together; the first has at least so many.
LONG_WORD, SHORTEST_START = 11, 5


def spellings(spend: DataFrame, contracts: DataFrame) -> DataFrame:
    """(name, lines, code, code_lines): each text with its lines and the postcode most often stated on them."""
    lines = spend.where("supplier_name_raw IS NOT NULL AND NOT coalesce(is_redacted, false)").select(F.col("supplier_name_raw").alias("name"), tidy_postcode(F.col("supplier_postcode_src")).alias("code"))
    counted = lines.groupBy("name", "code").agg(F.count(F.lit(1)).alias("n"))
    awarded = contracts.where("supplier_name_raw IS NOT NULL").select(F.col("supplier_name_raw").alias("name")).distinct().select("name", F.lit(None).cast("string").alias("code"), F.lit(0).cast("bigint").alias("n"))
    top = F.max(F.when(F.col("code").isNotNull(), F.struct("n", "code")))
    return counted.unionByName(awarded).where(F.trim("name") != "").groupBy("name").agg(F.sum("n").alias("lines"), top.alias("_t")).select("name", "lines", F.col("_t.code").alias("code"), F.coalesce("_t.n", F.lit(0)).alias("code_lines"))


def vocabulary(names: DataFrame, column: str = "name") -> tuple[dict[str, int], int]:
    """Common words of the names with their counts, and the count from which a word resolves short forms."""
    total = names.count()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for w in set(words(fold(t))):
                    counts[w] = counts.get(w, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    floor = max(LEAST_COMMON, total // COMMON_SHARE)
    found = names.select(column).mapInArrow(split, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).collect()
    skip = {*LEGAL_FORMS, "AND", "THE"}
    return {w: n for w, n in found if len(w) > 1 and w not in skip}, max(LEAST_STRONG, total // STRONG_SHARE)


_PARSED = "key string, core array<string>, form string, cut boolean, rare array<string>, twos array<string>, begun array<string>"


def parsed(names: DataFrame, common: dict[str, int], strong: int, column: str = "name") -> DataFrame:
    """``names`` with the parts of each: class key, core words, legal form, whether cut off, distinctive words and composite keys."""
    held = names.sparkSession.sparkContext.broadcast((common, strong))
    at = names.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(*held.value)
        for batch in batches:
            rows = [vocabulary.parse(t) for t in batch.column(at).to_pylist()]
            rare = []
            for r in rows:
                own = [w for w in r.core if len(w) >= 4 and w not in vocabulary.counts]
                rare.append(sorted(set(own)) or [" ".join(sorted(r.core))])
            more = [composite_keys(r, vocabulary) for r in rows]
            columns = [pa.array([r.key for r in rows]), pa.array([list(r.core) for r in rows], pa.list_(pa.string())), pa.array([r.form for r in rows]), pa.array([r.cut for r in rows]), pa.array(rare, pa.list_(pa.string())), *[pa.array([m[k] for m in more], pa.list_(pa.string())) for k in (0, 1)]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "key", "core", "form", "cut", "rare", "twos", "begun"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in names.schema)
    return names.mapInArrow(run, f"{kinds}, {_PARSED}")


def entry_words(classes: DataFrame) -> DataFrame:
    """(key, word, single, ...): what a class is found by: all its distinctive words.

    Composite keys, told by their ``&``, are rows beside these.  Rows with ``single`` false hold two neighbouring words
    written as one, beginnings of long words that hardly any class has, and the keys that only cut names meet; they meet only
    single words equal to them.
    """
    held = classes
    classes = held.drop("twos", "begun")
    composite = lambda column, single: held.withColumn("word", F.explode(column)).drop("rare", "twos", "begun").withColumn("single", F.lit(single))
    long = classes.withColumn("word", F.explode("rare")).drop("rare")
    often = long.groupBy("word").agg(F.count(F.lit(1)).alias("often"))
    counted = long.join(often, "word")
    single = long.withColumn("single", F.lit(True))
    # a long word of hardly any class may be two words run together with a slip; the first of them is one of its beginnings
    starts = F.transform(F.sequence(F.lit(SHORTEST_START), F.length("word") - 4), lambda n: F.substr(F.col("word"), F.lit(1), n))
    cut_words = counted.where((F.col("often") <= 2) & (F.length("word") >= LONG_WORD)).withColumn("word", F.explode(starts)).drop("often").withColumn("single", F.lit(False))
    twos = F.transform(F.sequence(F.lit(1), F.size("core") - 1), lambda k: F.concat(F.element_at("core", k), F.element_at("core", k + 1)))
    wide = classes.where(F.size("core") >= 2).withColumn("word", F.explode(F.array_distinct(twos))).drop("rare").withColumn("single", F.lit(False))
    return single.unionByName(wide.where(F.length("word") >= 8)).unionByName(cut_words).unionByName(composite("twos", True)).unionByName(composite("begun", False))


def near_words(entries: DataFrame) -> DataFrame:
    """(a, b): the near pairs among the distinctive words of ``entries``; composite keys only meet equal ones."""
    return near_pairs(entries.where("single AND length(word) >= 4 AND NOT contains(word, '&')").select(F.col("word").alias("text")), 1)


def dealt(entries: DataFrame) -> DataFrame:
    """``entries`` with the number of blocks of their word and their own block (parts, part); reads ``entries`` several times."""
    sizes = entries.groupBy("word").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > BLOCK)
    hot = sizes.select("word", F.ceil(F.col("_n") / F.lit(BLOCK)).cast("int").alias("parts"))
    return checked_join(entries, hot, ["word"], "left").fillna({"parts": 1}).withColumn("part", spread(F.col(entries.columns[0]), F.col("parts")))


def candidate_pairs(left: DataFrame, right: DataFrame, near: DataFrame) -> DataFrame:
    """Rows of ``left`` and ``right`` (columns prefixed a_ and b_), both of one ``dealt`` table, whose words are equal or a near pair.

    No word is too frequent: the blocks of a word of many rows form a grid, each cell of which is joined by itself.
    """
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hot = right.where("parts > 1").select(F.col("word").alias("b"), F.col("parts").alias("_parts")).distinct()
    both = checked_join(both, hot, ["b"], "left").fillna({"_parts": 1}).withColumn("_block", every("_parts")).drop("_parts")
    a = left.select(*[F.col(c).alias(f"a_{c}") for c in left.columns])
    b = right.select(*[F.col(c).alias(f"b_{c}") for c in right.columns])
    rows, columns = a.withColumn("_column", every("a_parts")), b.withColumn("_row", every("b_parts"))
    equal = rows.join(columns, (F.col("a_word") == F.col("b_word")) & (F.col("a_part") == F.col("_row")) & (F.col("_column") == F.col("b_part"))).where("a_single OR b_single").drop("_row", "_column")
    close = a.where("a_single").join(both, F.col("a_word") == both["a"]).join(b.where("b_single"), (F.col("b") == F.col("b_word")) & (F.col("_block") == F.col("b_part"))).drop("a", "b", "_block")
    return equal.unionByName(close)


def judged(pairs: DataFrame, common: dict[str, int]) -> DataFrame:
    """(a, b, sure, same_code): candidate pairs of classes that can mean one payee."""
    held = pairs.sparkSession.sparkContext.broadcast(common)
    fields = ["key", "core", "form", "cut", "code", "code_lines"]
    asked = pairs.select(*[f"{s}_{f}" for s in "ab" for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns]
            for ka, ca, fa, ta, pa_, na, kb, cb, fb, tb, pb, nb in zip(*columns, strict=True):
                kind = same_payee(Name(tuple(ca), fa, ta), Name(tuple(cb), fb, tb), held.value)
                if not kind:
                    continue
                same = None if pa_ is None or pb is None else pa_ == pb
                exact = sorted(ca) == sorted(cb)
                if same is False and not exact and na >= 2 and nb >= 2:
                    continue
                if kind != 2 and same is False:
                    continue
                va, vb = vague(Name(tuple(ca), fa, ta)), vague(Name(tuple(cb), fb, tb))
                if kind == 3:
                    va, vb = len(ca) < len(cb), len(cb) < len(ca)
                out.append((ka, kb, kind == 2 or (kind == 3 and bool(same)), bool(same), va, vb))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols[:2]] + [pa.array(c, pa.bool_()) for c in cols[2:]], names=["a", "b", "sure", "same_code", "a_vague", "b_vague"])

    return asked.mapInArrow(run, "a string, b string, sure boolean, same_code boolean, a_vague boolean, b_vague boolean").distinct()


def settle(links: DataFrame) -> DataFrame:
    """Components of the sure links, with the unsure ones added where they leave no choice: (node, component)."""
    links = cut(links)
    sure = links.where("sure").select("a", "b")
    firm = components(sure)
    weak = links.where("NOT sure")
    # only the vague end may choose: a full name with one vague neighbour says nothing about that neighbour's other choices
    ends = weak.where("a_vague").select(F.col("a").alias("node"), F.col("b").alias("other"), "same_code", F.col("b_vague").alias("vague")).unionByName(weak.where("b_vague").select(F.col("b").alias("node"), F.col("a").alias("other"), "same_code", F.col("a_vague").alias("vague")))
    name = lambda side: firm.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
    known = ends.join(name("node"), "node", "left").join(name("other"), "other", "left").select(F.coalesce("node_c", "node").alias("node"), F.coalesce("other_c", "other").alias("other"), "same_code", "vague").where("node <> other")
    full = ~F.col("vague")
    # a full name decides before other vague ones do
    choice = known.groupBy("node", "other").agg(F.max("same_code").alias("same_code"), F.min("vague").alias("vague")).groupBy("node").agg(
        F.count_if(full).alias("n"), F.count_if(full & F.col("same_code")).alias("n_same"), F.min(F.when(full, F.col("other"))).alias("only"), F.min(F.when(full & F.col("same_code"), F.col("other"))).alias("only_same"),
        F.min(F.when(F.col("same_code"), F.col("other"))).alias("fellow"))
    picked = choice.select("node", F.when(F.col("n_same") == 1, F.col("only_same")).when((F.col("n_same") == 0) & (F.col("n") == 1), F.col("only")).when(F.col("n") == 0, F.col("fellow")).alias("other")).where("other IS NOT NULL")
    agreed = picked.select(F.col("node").alias("a"), F.col("other").alias("b"))
    return components(sure.unionByName(agreed).unionByName(firm.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def name_clusters(names: DataFrame) -> DataFrame:
    """(name, cluster) for (name, lines, code, code_lines): spellings with the same cluster mean one payee.

    Every name appears, a name without variants in a cluster of its own.  Empty names parse to an empty core and meet only
    each other's equal keys.  Repeated names must have been counted once before.
    """
    names = names.persist(StorageLevel.MEMORY_AND_DISK)
    common, strong = vocabulary(names)
    rows = cut(parsed(names, common, strong))
    first = F.max(F.struct("lines", "name", "core", "form", "cut", "rare", "twos", "begun")).alias("_f")
    code = F.max(F.when(F.col("code").isNotNull(), F.struct("code_lines", "code"))).alias("_c")
    classes = rows.groupBy("key").agg(first, code).select("key", "_f.core", "_f.form", "_f.cut", "_f.rare", "_f.twos", "_f.begun", F.col("_c.code").alias("code"), F.coalesce("_c.code_lines", F.lit(0)).alias("code_lines"))
    entries = dealt(cut(entry_words(classes)))
    near = cut(near_words(entries))
    pairs = candidate_pairs(entries, entries, near).where("a_key <> b_key").select(*[F.when(F.col("a_key") < F.col("b_key"), F.col(f"{x}_{c}")).otherwise(F.col(f"{y}_{c}")).alias(f"{x}_{c}") for x, y in ("ab", "ba") for c in ("key", "core", "form", "cut", "code", "code_lines")]).dropDuplicates(["a_key", "b_key"])
    groups = settle(judged(pairs, common))
    return rows.select("name", "key").join(groups.withColumnRenamed("node", "key"), "key", "left").select("name", F.coalesce("component", "key").alias("cluster"))


def variant_pairs(spend: DataFrame, contracts: DataFrame) -> DataFrame:
    """(name_a, name_b) with name_a < name_b: different texts that mean the same firm or person.

    The result form asks for every pair of spellings of a payee; equal texts are one spelling however many lines carry
    them.  NULL and blank names and redacted lines take no part; empty tables give no pair.
    """
    clusters = cut(name_clusters(spellings(spend, contracts)))
    a, b = clusters.select(F.col("name").alias("name_a"), "cluster"), clusters.select(F.col("name").alias("name_b"), "cluster")
    return a.join(b, "cluster").where("name_a < name_b").select("name_a", "name_b")
