import hashlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbago.llm import pieces
from plumbago.llm.entry import op5_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIB = sentencepiece.SentencePieceProcessor(model_file=PATH)
HARD = ["", " ", "  ", "a", " a", "a  b   c    d", "tab\there\nline\r\n", "▁ odd ▁▁ marks▁", "漢字かな交じり", "😀 emoji 👩‍👩‍👧", "ﬁ ligature ½", "\x01\x02 ctl", "é" * 300, "x" * 4000, "word " * 2000, "<s> </s> <unk> <0x41>", "naïve café", "end "]


def check(enc, text, got):
    shown, ids, starts, ends = got
    want = LIB.encode(text)
    assert ids.tolist() == want and shown == ",".join(map(str, want))
    raw = text.encode()
    assert b"".join(raw[s:e] for s, e in zip(starts, ends, strict=True)) == raw
    for i, s, e in zip(want, starts, ends, strict=True):
        name = LIB.id_to_piece(i)
        if not LIB.is_byte(i) and pieces.BLANK not in name:
            assert raw[s:e].decode() == name


def test_ids_and_spans_equal_the_library():
    enc = pieces.PieceEncoder(PATH)
    assert enc.by_segment and enc.normalize.plain
    for t, got in zip(HARD, enc.encode(HARD), strict=True):
        check(enc, t, got)


@settings(max_examples=150, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nab."), st.characters(exclude_categories=["Cs"], exclude_characters="\0")), max_size=40))
def test_any_text(text):
    enc = pieces.encoder(PATH)
    check(enc, text, enc.encode([text])[0])


def test_walk_equals_replacement():
    enc = pieces.PieceEncoder(PATH)
    fast = enc.encode(HARD)
    enc.normalize.plain = False
    for a, b in zip(fast, enc.encode(HARD), strict=True):
        assert a[0] == b[0] and all((x == y).all() for x, y in zip(a[1:], b[1:], strict=True))


def test_compiled_map_equals_the_library():
    for rule in ("nfkc", "nmt_nfkc", "nmt_nfkc_cf"):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        spec = {f: v for x, y, _ in pieces._fields(lib.serialized_model_proto()) if x == 3 for f, v, _ in pieces._fields(y)}
        mine = pieces.Normalizer(spec)
        assert mine.map.units
        for t in HARD + ["Ｆｕｌｌ　width", "ＡBＣ ①②③ ㍿", "é äo", "ẛ̣", "ﷺ x"]:
            if t:
                assert mine(t)[0].decode() == lib.normalize(t), (rule, t)
                assert len(mine(t)[1]) == len(mine(t)[0]) + 1 and (np.diff(mine(t)[1]) >= 0).all()


def test_squeezed_blanks():
    n = pieces.Normalizer({3: 1, 4: 1, 5: 1})
    text, align = n("  a   b  ")
    assert text.decode() == "▁a▁b" and align.tolist() == [2, 2, 2, 2, 3, 3, 3, 6, 7]
    assert n("   ")[0] == b""


def test_query_against_the_library(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in op5_pieces(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = LIB.encode(t)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(LIB.decode(ids)))


def test_rows_and_round_trip(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "two words", "x"), (2, "two words", "x"), (2, "two words", "x"), (3, "y " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = pieces.encode(df, PATH)
    back = pieces.decode(enc, PATH).collect()
    assert sorted((str(r[0]), r[1]) for r in back) == sorted((str(i), t or "") for i, t, _ in rows)
    assert pieces.round_trip(df.limit(0), PATH).count() == 0
    assert pieces.round_trip(df, PATH).count() == 6
