"""Chains of literals in the secret scan, read to their ends."""

import random
import time

import pytest

from zetasky.llm import secrets


def literals(text):
    return [text[a:b] for k, a, b in secrets.find_secrets(text)[1] if k == "literal"]


PARTS = [f"q{i}Z" for i in range(40)]


@pytest.mark.parametrize("joint", [" + ", " +\n    ", "\n    + ", " + \\\n  "])
def test_direct_chain_is_read_to_its_end(joint):
    assert literals("db_password = " + joint.join(f'"{p}"' for p in PARTS) + '\nurl = "x"') == PARTS


def test_chain_through_constants_is_whole():
    names = "\n".join(f'part{i} = "{p}"' for i, p in enumerate(PARTS))
    halves = "left = " + " + ".join(f"part{i}" for i in range(20)) + "\nright = " + " + ".join(f"part{i}" for i in range(20, 40))
    assert literals(f"{names}\n{halves}\nauth_token = left + right") == PARTS
    late = 'base = "aB3"\n' + "".join("base = base + base\n" for _ in range(400)) + 'auth_token = base + "xY7-Qw9_Zk2"'
    assert literals(late) == []  # all but a vanishing share of the value is aB3 again and again
    deep = 'key = ""\n' + "".join(f'key = key + "{i:x}Q"\n' for i in range(3000)) + "auth_token = key"
    assert len(literals(deep)) == 3000


def test_score_of_a_chain_is_the_score_of_its_value():
    for parts in (["Zx81kk02", "Qp77mm13"], ["exam", "pleZx81kk02"], ["e", "xam", "ple", "Zx81kk02Q"], ["Zx8", "1k"], ["a b", "Zx81kk02"]):
        text, ends = "".join(parts), [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
        chain = secrets.Chain(list(zip([0, *ends], ends, strict=False)))
        assert secrets.literal_score(*chain.summary(text)) == secrets.literal_score(*secrets.summary_of(text))


def test_lines_that_begin_with_a_plus():
    patch = '-auth_token = "Zx81kk02Qp77mm13"\n+auth_token = "Kd92ll13Rt88nn24"\n+"name": "Zx81kk02aa"'
    assert literals(patch) == ["Zx81kk02Qp77mm13", "Kd92ll13Rt88nn24"]
    assert literals('auth_token = "Zx81kk02Qp77mm13"\n+ plain words') == ["Zx81kk02Qp77mm13"]


def test_long_names_are_read_whole():
    name = "secret_" + "x" * 100
    assert [s for s in secrets.find_secrets(f'{name} = "s3cr3T-Value-0042"')[1] if s[0] == "literal"] == [("literal", 111, 128)]
    blank = "n" * 50_000 + "!" + " " * 50_000 + "= "
    assert secrets.find_secrets(blank * 3)[1] == []


def plain_spans(text, threshold=0.6):
    """The added spans by lists that are built anew for every operator; a place behind a plus sign is read once."""
    known, tails, found, before = {}, {}, set(), 0

    def after(end):
        plus = secrets.PLUS.match(text, end)
        if not plus:
            return []
        at = plus.end()
        if at not in tails:
            term, tails[at] = secrets.TERM.match(text, at), []
            if term:
                value = next((term[g], *term.span(g)) for g in (1, 2, 3) if term[g] is not None)
                constant = known.get(value[0]) if term[3] is not None else None
                on_next_line = "\n" in text[end : text.index("+", end)]
                if not (on_next_line and (term[3] is not None and not constant or secrets.ASSIGNED.match(text, at))):
                    tails[at] = (constant or [value]) + after(term.end())
        return tails[at]

    for op in secrets.OPERATOR.finditer(text):
        at, since, before = op.start(), before, op.end()
        if op[0] == "=" and (text[at - 1 : at] in ("=", "!", "<", ">", ":") or text[at + 1 : at + 2] in ("=", ">")) or op[0] == ":" and text[at + 1 : at + 3] == "//":
            continue
        name, term = secrets.NAME_BEFORE.match(text[since:at][::-1]), secrets.TERM.match(text, op.end())
        if name and term:
            value = next((term[g], *term.span(g)) for g in (1, 2, 3) if term[g] is not None)
            parts = (known.get(value[0]) if term[3] is not None else None) or [value]
            parts = known[name[1][::-1]] = parts + after(term.end())
            weight = secrets.name_score(name[1][::-1])
            if weight and weight * secrets.literal_score(*secrets.summary_of("".join(p[0] for p in parts))) >= threshold:
                found |= {("literal", a, b) for _, a, b in parts if b > a}
    return found


ATOMS = ["token", "password", "api_key", "k", "x", "abcDEF123456zz", "Zx9Qw8Er7Ty6", '"q1W2e3R4t5Y6"', "'aa bb'", "=", "=", ":=", "=>", ":", "+", " + ", "\n+", "\n", " ", ",", "//", "\\\n", '"', "'"]


def test_shared_tails_give_the_spans_of_plain_lists():
    rng, some = random.Random(5), 0
    for _ in range(8000):
        text = "".join(rng.choice(ATOMS) for _ in range(rng.randint(2, 16)))
        want = plain_spans(text)
        some += bool(want)
        assert {s for s in secrets.find_secrets(text)[1] if s[0] == "literal"} == want, text
    assert some > 200


@pytest.mark.parametrize("piece", ["x=a+", "token=a1B2c3D4e5F6+", "token=", "x=a+x+", "=x", "k=v=w + ", 'k="a=b+"+'])
def test_a_megabyte_of_operators_takes_seconds(piece):
    began = time.process_time()
    secrets.find_secrets(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 60
