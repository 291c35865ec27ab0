import random

import pytest

from tidemark.llm import token_counts
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_counts import Counter


def test_prefixes_of_words_are_solved_once():
    c, asked = Counter(tokenizer_path()), []
    fits = c.fits
    c.fits = lambda a, b: asked.append(b) or fits(a, b)
    c.table("so antidisestablish")
    asked.clear()
    c.table("so antidisestablishm, antidisestablishm. antidisestablishm")
    assert asked == [b"hm", b"m"]


@pytest.mark.parametrize("memo", [1, 3, 1_200_000])
def test_tables_with_kept_prefixes_are_the_librarys(monkeypatch, memo):
    from tokenizers import Tokenizer

    t, r = Tokenizer.from_file(tokenizer_path()), random.Random(9)
    monkeypatch.setattr(token_counts, "MEMO", memo)
    c = Counter(tokenizer_path())
    parts = ["über", "ñandú", "tion", "é", "'re", "'", "ß", ",", "\n", "\n\n", "%%%", "12", "\xa0", " ", " ", " ", "x" * 63, "é" * 40]
    for _ in range(150):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 9)))
        want = [len(t.encode(s[:i], add_special_tokens=False).ids) for i in range(len(s) + 1)]
        assert c.table(s).tolist() == want, s
        for budget in (0, 3, want[-1]):
            assert c.within(s, budget) == (want[-1], token_counts.longest_within(want, budget)), s
