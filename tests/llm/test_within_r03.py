from tidemark.llm.queries import tokenizer_path
from tidemark.llm.token_counts import Counter, longest_within


def test_within_is_the_table():
    c = Counter(tokenizer_path())
    text = "A few words, then antidisestablishmentarianism; and more of it: 12345 is'nt.\nLine two " * 3
    t = c.table(text)
    for budget in range(0, int(t[-1]) + 2):
        assert c.within(text, budget) == (int(t[-1]), longest_within(t, budget))
    assert c.within("", 5) == (0, 0)
