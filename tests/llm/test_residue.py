import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import residue as R

DATA = "/root/testdata/sf0.1/documents.parquet"
PLAIN = ["The award notice names Acme Taxis Ltd of Netherwick as the winning bidder.", "Spending on road marking in Fencombe reached £17,049 by 18/03/2022.", "La facture PB-6157/36 a été vérifiée à Pellhithe.", "Rund 447 Buchungen wurden nach dem 04.03.2023 berichtigt.", "Members noted the cost of lift servicing, now £3,021 a year."]
BAD = ["404 Not Found\nThe page ND-7136/35 could not be found on this server.", "Dear {{first_name}}, your claim was received on [INSERT date].", "Lorem ipsum dolor sit amet.", "Supplier: undefined. Amount: NaN.", "Please enable JavaScript to view the payment tables.", "Access denied. You do not have permission to open file A-1.", "java.lang.IllegalStateException: no row for A-1\n at spend.load.Reader.next(Reader.java:188)", "test test test test", "Reference: None\nLate lines for grounds upkeep came to £1,800 in 4044 rows.", PLAIN[1] + " Please\n> enable JavaScript to view the tables. " + PLAIN[4], "Balance: #REF!", "Bitte aktivieren Sie JavaScript, um die Liste zu sehen.", "sample text sample text sample text sample text"]
DECOYS = ["A placeholder of £24,023 had stood in the plan; the audit panel has now set the real figure.", "Room 404 at Drummoor will be used for asbestos surveys meetings, room 503 for storage.", "The new portal no longer needs JavaScript, which most readers had asked for.", "In the list [A] marks property lines, [B] marks travel lines and 3543 have neither.", "Price per unit was $12 during the audit, then £14; 50% of 1466 orders were hit.",
          "Access was denied to Acme Ltd by the owner of the depot, so work began late.", "The audit panel counted 2945 visits that met a page-not-found message and mended the links.", "Staff were trained to replace every merge field before a notice leaves the office.", "The outage of 2024-08-07 lasted 4536 minutes."]
#: Residue whose wording no trusted phrase holds, for the model to find.
UNLISTED = ["Server Error in '/' Application.", "This site requires scripts and JavaScript to function.", "The page you asked for was not found on this server.", "You do not have the permission to view this page.", "{ { first_name } }"]


@pytest.mark.parametrize("text", BAD)
def test_trusted_passages(text):
    assert any(R.Trust()(p) for p in R.passages(text))


@pytest.mark.parametrize("text", DECOYS + PLAIN)
def test_passages_that_speak_of_it(text):
    assert not any(R.Trust()(p) for p in R.passages(text))


@pytest.mark.parametrize("text", ["java.lang.OutOfMemoryError", "at com.shop.Cart.total(Cart.kt:88)", "x <%= Name %> y", "on DD/MM/YYYY", "TypeError: x", 'File "a.py", line 3', "Service Temporarily Unavailable"])
def test_each_trusted_passage_is_called_for(text):
    """The quick look at a passage's tokens never hides one from the test proper."""
    assert R.Trust()(text)
    assert R.Lexer(R.Trust()).read(["plain words. " + text, text], test=True).trusted.sum() == 2


def test_passages_rows_and_repeats():
    found = R.Lexer(R.Trust()).read(["One two. Three!\n> four", None, "", " \n ", "five five five five"], test=True)
    assert found.row.tolist() == [0, 0, 0, 4]
    assert found.trusted.tolist() == [False, False, False, True]
    assert [len(p) for p in np.split(found.codes, found.begins[1:])] == [3, 2, 1, 4]
    assert list(R.pieces(["a" * 5, None, "b" * 9, "c"], 8)) == [slice(0, 3), slice(3, 4)]


def test_documents(spark):
    """Every kind of residue amid the corpus of the test tables, whatever stands around it; texts that speak of it are none."""
    own = [*BAD, *DECOYS, *UNLISTED, None, "", " \n ", *PLAIN, BAD[0], "plain words. " * 20_000 + BAD[2]]
    df = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(own)], "doc_id bigint, text string").unionByName(spark.read.parquet(DATA).select("doc_id", "text")).withColumn("passages", F.lit(1))
    got = {-1 - r["doc_id"] for r in R.residue_documents(df).where("doc_id < 0").collect()}
    missed = {*range(len(BAD)), *range(len(BAD) + len(DECOYS), len(BAD) + len(DECOYS) + len(UNLISTED)), len(own) - 2, len(own) - 1} - got
    assert not missed, [own[k][:60] for k in missed]
    assert got == {*range(len(BAD)), *range(len(BAD) + len(DECOYS), len(BAD) + len(DECOYS) + len(UNLISTED)), len(own) - 2, len(own) - 1}


def test_empty_and_clean_tables(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(PLAIN)], "doc_id bigint, text string, passages int")
    assert R.residue_documents(df).count() == 0
    assert R.residue_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [2, 3])
def test_half_of_the_phrases_finds_nine_tenths(spark, seed):
    """With half of the patterns and phrases unknown, the model still finds what they would have labelled."""
    documents = spark.read.parquet(DATA).select("doc_id", "text")
    everything = {r[0] for r in R.residue_documents(documents).select("doc_id").collect()}
    rng = random.Random(seed)
    half = lambda xs: rng.sample(xs, len(xs) // 2)
    fewer = {r[0] for r in R.residue_documents(documents, trust=R.Trust(half([*R.PLACEHOLDERS, *R.FAILED]), half(R.PHRASES))).select("doc_id").collect()}
    assert len(fewer & everything) >= 0.9 * len(everything)
    assert len(fewer & everything) >= 0.98 * len(fewer)
