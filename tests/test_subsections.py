"""Like subsections of long sections against a serial loop."""

from plumbago.functions import similarity as S
from plumbago.operators import notes


def test_subsections_beyond_the_twelfth_own_later_ones(spark):
    heads = [f"{w}" for w in "amber basil cedar delta ember fjord grape hazel ivory joker kayak lemon".split()] + ["quiet river stone", "mango", "quiet river", "Amber"]
    words = [{w for w in h.lower().split() if w not in S.SUBSECTION_STOPS} for h in heads]
    owner, kept = [], []
    for i, ws in enumerate(words):
        owner.append(next((k for k in kept if len(ws & words[k]) >= 0.55 * max(len(ws), len(words[k]))), i))
        if owner[i] == i:
            kept.append(i)
    named = {k: min((h for h, o in zip(heads, owner, strict=True) if o == k), key=len) for k in kept}
    points = spark.createDataFrame([(1, "Notes", 0, "Section", i, h, 0, f"point {i}") for i, h in enumerate(heads)], "notes_id long, title string, sec_pos int, sec_heading string, sub_pos int, sub_heading string, pt_pos int, text string")
    got = {r["text"]: r["sub_heading"] for r in notes.merged_like_subsections(points).collect()}
    assert got == {f"point {i}": named[o] for i, o in enumerate(owner)} and got["point 12"] == got["point 14"] == "quiet river" and len(kept) == 14
