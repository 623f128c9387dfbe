"""Texts that the tests share."""

WORDS = "the of and river stone cloud paper green seven lantern winter garden music table bridge honest silver morning quiet travel window story market".split()


def prose(seed, n=60):
    """Deterministic filler: sentences of common words."""
    out, x = [], seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        word = WORDS[(x >> 8) % len(WORDS)] + ("" if (x >> 4) % 3 else str((x >> 12) % 97))
        out.append(word.capitalize() if i % 9 == 0 else word + ("." if i % 9 == 8 else ""))
    return " ".join(out)


#: Awkward inputs: null, empty, blank, controls, other scripts, no letters, one word, a very long text.
ODD = [None, "", "   ", "\n\n\t", "\x00\x01", "é ü ß", "日本 語 テスト", "!!!", "word", "a b c d", "x " * 20_000, "line\n" * 50, "ABC def. " * 7]
