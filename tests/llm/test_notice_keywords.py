"""Each rule's pattern only matches text that holds one of its keywords."""

import random
import re._parser as parser

from tessera.llm import licenses


def strings(tree, rng):
    """One random string that a parsed pattern matches (no classes but those that the rules use)."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "BRANCH":
            out += strings(rng.choice(arg[1]), rng)
        elif name == "SUBPATTERN":
            out += strings(arg[3], rng)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            out += "".join(strings(inner, rng) for _ in range(rng.randint(low, min(high, low + 1))))
        elif name == "IN":
            kind, value = rng.choice([x for x in arg if str(x[0]) != "NEGATE"])
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else {"CATEGORY_SPACE": " ", "CATEGORY_DIGIT": "2", "CATEGORY_WORD": "x", "CATEGORY_NOT_WORD": "'"}[str(value)]
    return out


def test_every_match_holds_a_keyword():
    rules, by_word = licenses.build_rules()
    rng, lost = random.Random(4), []
    for k, rule in enumerate(rules):
        tree, words = parser.parse(rule.pattern.pattern), [w for w, at in by_word.items() if k in at]
        made = {strings(tree, rng) for _ in range(60)}
        lost += [(rule.label, rule.kind, m[0]) for m in map(rule.pattern.search, made) if m and not any(w in m[0] for w in words)]
    assert lost == []


def test_sign_alone_is_a_notice():
    found = licenses.Scanner().detect("© 2021 name")
    assert [(r.label, r.kind) for _, _, r in found] == [("copyright", "notice")]
