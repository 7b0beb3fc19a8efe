import numpy as np
from gleanery.llm import pieces


def test_words_that_differ_are_the_librarys(monkeypatch):
    """Long words are checked too; where agenda and library differ the library's ids stand, and are marked."""
    agenda = pieces.Agenda(pieces.public_tokenizers.path(pieces.DEFAULT_MODEL))
    long = "https://example.org/" + "a1b2/" * 20 + "x" * 10_000
    texts = [f"see {long} here", "see nothing", f"again {long}"]
    right = [np.array(agenda.sp.encode(t), "<u4").tobytes() for t in texts]
    assert len(long) > pieces.LONGEST and agenda.encode_all(texts) == [(x, False) for x in right]
    real = agenda.encode_word
    monkeypatch.setattr(agenda, "encode_word", lambda word: b"\0\0\0\0" if "x" in word or word == "▁here" else real(word))
    agenda.words.clear()
    for _ in range(2):
        assert agenda.encode_all(texts) == [(right[0], True), (right[1], False), (right[2], True)]
    assert set(agenda.settled) == {long, "here"} and long not in agenda.words
