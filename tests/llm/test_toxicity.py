import zlib

import numpy as np
import pytest

from plumbago.llm import toxicity as t


@pytest.fixture(scope="module")
def channel():
    text = "the idiot was a stupid clown and the loser is pathetic trash of the scum this is a moron disgusting worthless class letter will be apple book " * 50
    return t.Channel.trained(t.trigram_counts(text))


@pytest.mark.parametrize("written,read", [("1d10t", "idiot"), ("stup1d", "stupid"), ("l0ser", "loser"), ("tr@sh", "trash"), ("m0r0n", "moron"), ("i d i o t", "idiot"), ("s.t.u.p.i.d", "stupid"), ("stuuuupid", "stupid"), ("looooser", "loser"), ("cl0wn", "clown"), ("p@th3tic", "pathetic")])
def test_disguises_are_read(channel, written, read):
    assert t.Restorer(channel)(f"Well, {written.upper()} there") == f"well, {read} there"


@pytest.mark.parametrize("plain", ["a plain line, of words.", "call 555 1234 now", "x = 3 + 4", "word!! word!!", "über größe", ""])
def test_plain_text_stays(channel, plain):
    assert t.Restorer(channel)(plain) == plain


def test_viterbi_equals_enumeration(channel):
    import itertools
    import math

    def total(read, cost):
        codes = [0, 0, *(ord(c) - 96 if c.isalpha() else 0 for c in read), 0]
        return cost + sum(channel.source[a, b, c] for a, b, c in zip(codes, codes[1:], codes[2:], strict=False))

    for written in ("1d10t", "l1l1", "c1a55"):
        options = [[(r, channel.swap) for r in t.READINGS[c]] + [("", channel.drop)] if c in t.READINGS else [(c, 0.0)] for c in written]
        best = max(total("".join(x[0] for x in combo), sum(x[1] for x in combo)) for combo in itertools.product(*options))
        got = channel.restore(written)
        reached = [total("".join(x[0] for x in combo), sum(x[1] for x in combo)) for combo in itertools.product(*options) if "".join(x[0] for x in combo) == got]
        assert math.isclose(max(reached), best)


def test_held_out_accuracy_and_disguised_copies(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = t.train(docs, labels)
    rows = t.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    tp = sum(r["predicted"] and r["toxic"] for r in rows)
    assert tp / sum(r["predicted"] for r in rows) > 0.95 and tp / sum(r["toxic"] for r in rows) > 0.85
    plain = "Or the, idiot thaninwh thheer erblend. Thorreor stupid haheor atshti it of ingth pathetic oner. "
    worn = plain.replace("idiot", "1d1ot").replace("stupid", "s t u p i d").replace("pathetic", "patheeeetic")
    assert model.score(plain) > 0.9 and model.score(worn) > 0.9
    assert model.score("Or the thaninwh thheer erblend. Thorreor haheor atshti it of ingth oner.") < 0.2 and 0 <= model.score("") < 0.5


def test_folds_nulls_and_clashes(spark):
    docs = spark.createDataFrame([(i, "vile rotten word" if i % 2 else "kind soft word", "z") for i in range(60)] + [(None, None, "z"), (77, "", "z"), (77, "vile rotten " * 3000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (5, 0), (900, 1), (6, None)], "doc_id long, toxic int")
    out = t.toxicity(docs, labels).collect()
    assert len(out) == 63
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    assert {r["predicted"] for r in out if r["doc_id"] is not None and r["doc_id"] < 60 and r["doc_id"] % 2} == {1}
    assert t.toxicity(docs, labels.limit(0)).first()["score"] == 0.5
    assert t.toxicity(docs.limit(0), labels).count() == 0


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs = spark.createDataFrame([(i, "vile word" if i % 3 else "kind word") for i in range(80)], "doc_id long, text string")
    rows = [(i, int(i % 3 > 0)) for i in range(80)]
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in rows]
    a, b = (sorted(map(tuple, t.toxicity(docs, spark.createDataFrame(x, "doc_id long, toxic int")).collect())) for x in (rows, turned))
    assert a == b and np.isfinite([r[2] for r in a]).all()


@pytest.mark.parametrize(
    "written,read",
    [("worthle$$", "worthless"), ("worthle55", "worthless"), ("idi07", "idiot"), ("m0r0n", "moron"), ("5cum", "scum"), ("w0rthle$5!", "worthless!"), ("(stup1d", "(stupid"), ("s t u p 1 d", "stupid"), ("s.7.u.p.i.d", "stupid"), ("stuuup1d", "stupid"), ("s, c, u, m", "scum"), ("s  c  u  m", "scum"), ("i-d-i-0-7", "idiot"), ("w a s", "was"), ("1111diot", "idiot")],
)
def test_last_letters_and_mixed_disguises_are_read(channel, written, read):
    assert t.Restorer(channel)(f"Well: {written.upper()} there") == f"well: {read} there"


@pytest.mark.parametrize("plain", ["idiot!", "(the class)", "**the** book!!!", "1, 2, 3, 4", "5 x 1 + 2", "the letter +"])
def test_numbers_and_marks_beside_words_stay(channel, plain):
    assert t.Restorer(channel)(plain) == plain


def test_long_words_and_stretches_take_linear_time(channel):
    import time

    restore, start = t.Restorer(channel), time.time()
    assert restore("ab" * 500_000) == "ab" * 500_000
    assert len(restore("ab" * 250_000 + "ccc" + "ab" * 250_000)) < 1_000_004
    assert restore("x " + "1" * 500_000) == "x " + "1" * 500_000
    assert restore("i d i o t " * 5_000).count("idiot") > 4_900
    assert time.time() - start < 60


@pytest.mark.parametrize("c", [*(chr(i) for i in range(32, 127)), "\t", "\n", "é", "€", "字", "\u200b"])
def test_a_megabyte_of_one_character_takes_linear_time(channel, c):
    import time

    restore, start = t.Restorer(channel), time.time()
    restore(f"a {c * 1_000_000} b")
    restore(f"{c * 1_000_000} i d i o t")
    assert time.time() - start < 4


@pytest.mark.parametrize("written,read", [("$$$$ t u p i d", "stupid"), ("x $$ t u p i d", "x stupid")])
def test_runs_of_marks_still_begin_a_stretch(channel, written, read):
    assert read.split()[-1] in t.Restorer(channel)(written)
