"""Every rule over phrases that break it and phrases that don't, and the steps of notes and alignment over the same.

The registered queries run over a small documents table whose texts are these phrases, about some places, and are held
against their SQL over the same table.
"""

import re

import duckdb
import pytest

from plumbago.plans import registry, rules, texts
from tests.test_entry import SF, TABLES, canonical

PHRASES = (
    "{x} is a type of {x}.", "{x} contains {x}", "{x} is a {x} of the kind that is known.", "{x} is handled by {x} Handler.", "{x}: Linear Data Structure exemplified by {x}.", "{x}: Operations on Stack is a {x}",
    "{x} is a key concept within {x}", "{x} covers what was discussed in the last session.", "We will cover {x} later in detail.", "It used {x} for storage, and they stored it.", "{x} Analysis generates tokens of the input.",
    "Analysis generates {x} for each of the inputs", "Afor example {x} is the one that counts here", "Unit 4: {x} and what it is made of", "{x} categorizes several kinds of trade goods", "Top {n} parsers: a type of parser",
    "{x} encompasses several key components, as trade", "previously observed, {x} has ports and ships", "A stack is an abstract data type (ADT) of {x}", "perations of {x} are many", "A is a {x}", "p {x} is",
    "{x} and Subject", "{x} Trade and Returns", "{x} provides goods that are stored in ports by traders of the region.", "{x}", "{x} key points", "Key Takeaway of {x}", "Introduction to {x}", "Course on {x}", "Overview", "12) {x}",
    "BT {x} 0.000 g 59.53 735.83 Td ET", "{x} 4c7p1xz data", "{x} %%%%&&&&!!!!", "101 {x} 102 Robin 103 Alya 104 Yusuf 105", "Student ID {x} 10 20 30 40 50 60", "and {x} is bigger", "Of {x}", "of {x} there are many ports",
    "Each {x} has", "2 lists of {x}", "the {x} port", "a picture of {x} with ships", "{x} IS THE BIG one of GREAT PORTS", "{x} exam pattern of the year", "tutorial by {x}", "8itmap bnode {x}", "aaaaa {x} bbbbb", "ships Xyz {x}",
    "(Data {x}", "definition", "components", "inserted", "Components and Structure", "{x} ? Chapter", "{x} ? Stack of goods", "don?t ask {x}?s port ?", "{x} involves Ports: Ports:a port.", "{x} stores goods during its operation.",
    "{x} holds goods - Introduced in a previous session: goods.", "{x} is an Port and is an apple", "Because {x} isn't big, it's twenty one ports; two hundred ships.", "“{x}” – → ports ??", "welcome to this lecture on {x}, thanks for watching", "------", "x", "The {x} trades goods for its people, and it is known for them.",
    "which {x} has many ports in it", "such {x} is one", "{x} + 2 = 3", "0.5 * y / 3", "{x} are controlled by {x} Manager", "{x} is managed by Traders", "What is {x} ?", "ports by. {x} of.", "{x} trades goods by.",
    "subscribe to the channel of {x} now", "welcome back to {x} and its ports", "int main of {x} is code", "{x} is defined as a region that means trade", "a {x} represents ports and ships",
)
SECTIONS = ("{x} Ports", "Course on {x}", "Introduction to {x}", "Overview", "key points", "Definition ? [{x}] Ports", "{x} Ports and Trade", "Ports of {x}")
SUBSECTIONS = ("Key Concepts", "Key Takeaways", "Process Flow", "{x}", "Goods of the Ports", "The goods, of ports")
REFERENCES = (
    "{x} is responsible for trade in goods.", "{x} handles ships of the region, and it performs checks.", "The {x} trades goods for its people, and it is known for them.", "Nothing of this is said at all here.",
    "Steel mills of {x} means that iron is made.", "{x} converts iron ore into steel.", "A {x} contains ports that are known as Sea Ports, or HUB-like ports.",
)
PLACES = ("ALGERIA", "BRAZIL", "CHINA", "UNITED KINGDOM", "NATION_4", "Éire", "Peru", "Item 0", "JAPAN", "KENYA", "FRANCE", "INDIA")
SOURCE = "".join(open(m.__file__).read() for m in (rules, texts))
NAMES = sorted(n for n in registry.QUERIES if re.search(rf'def {n}\(|"{n}": \(', SOURCE))


def text_of(k: int) -> str:
    """A heading, then the phrases in tens, each ten under a heading; two kinds of place have two lines only."""
    lines = [SECTIONS[k % len(SECTIONS)], *PHRASES] if k % 5 else [SECTIONS[k % len(SECTIONS)], *PHRASES[:2]]
    out = []
    for i, line in enumerate(lines):
        if i and len(out) % 10 == 0:
            out.append(SUBSECTIONS[(len(out) // 10 + k) % len(SUBSECTIONS)])
        out.append(line)
    return "\n".join(out).replace("{x}", PLACES[k]).replace("{n}", PLACES[k].lower())


@pytest.fixture(scope="module")
def phrased(spark, tmp_path_factory):
    """A folder of tables whose documents and benchmark are the phrases, and DuckDB over it."""
    folder = str(tmp_path_factory.mktemp("phrases"))
    con = duckdb.connect()
    own = {
        "documents": spark.createDataFrame([(k, text_of(k)) for k in range(len(PLACES))] + [(900, None), (901, ""), (902, " \n\n ")], "doc_id long, text string"),
        "benchmark": spark.createDataFrame([(k, " ".join(REFERENCES).replace("{x}", PLACES[k])) for k in range(6)] + [(6, None)], "item_id long, text string"),
    }
    for t in TABLES:
        if t in own:
            own[t].coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        else:
            spark.read.parquet(f"{SF}/{t}.parquet").coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_rule_over_phrases(spark, phrased, name):
    folder, con = phrased
    df = registry.QUERIES[name](spark, folder)
    want = con.sql(registry.ORACLE_SQL[name])
    got = canonical(df.collect(), df.columns)
    assert sorted(df.columns) == sorted(want.columns) and got == canonical(want.fetchall(), want.columns)


def test_every_rule_is_met_and_missed(spark, phrased):
    folder, _ = phrased
    for name in ("bullet_noise", "bullet_damage", "bullet_loops", "heading_rules"):
        rows = registry.QUERIES[name](spark, folder).collect()
        for c in rows[0].asDict():
            assert c == "bullet_id" or {r[c] for r in rows} >= {True, False}, c


def test_real_lines_grow_with_the_tables(spark):
    assert registry.QUERIES["bullet_noise"](spark, "/root/testdata/sf0.01").count() > 4 * registry.QUERIES["bullet_noise"](spark, SF).count()


def test_accents(spark):
    from pyspark.sql import functions as F

    from plumbago.functions import text as T

    row = spark.createDataFrame([("moré Définition ÅÑ e\u0301 ßæø 字 ǭ",)], "t string").select(T.without_accents(F.col("t")).alias("t")).first()
    assert row["t"] == "more Definition AN e ßæø 字 o"


def test_repeated_phrases(spark):
    import random
    import time

    from plumbago.operators import phrases

    rng = random.Random(5)

    def brute(words):
        for n in range(6, 2, -1):
            for i in range(len(words) - n + 1):
                for j in range(i + 1, len(words) - n + 1):
                    if words[i : i + n] == words[j : j + n]:
                        return j, n
        return None

    for _ in range(400):
        words = rng.choices("abcd", k=rng.randrange(0, 24))
        assert phrases.repeat(words) == brute(words)
    start = time.time()
    phrases.collapsed(" ".join(f"w{i}" for i in range(100_000)))
    phrases.collapsed("same " * 100_000)
    assert time.time() - start < 5
    rows = [(1, "a b c d a b c e"), (1, None), (2, "x y"), (3, "the cat sat. and the cat sat. .")]
    got = sorted(map(tuple, phrases.without_repeated_phrases(spark.createDataFrame(rows, "k int, text string"), "k").collect()))
    assert got == [(1, ""), (1, "a b c d e."), (2, "x y"), (3, "the cat sat. and.")]
