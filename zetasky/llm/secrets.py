"""Secret scanning by assignment-aware lexing.

Source and configuration text is lexed into name-literal pairs (``name = "x"``, ``name: x``, ``"name": "x"``,
``name := x``, ``name => x``), constants are carried along assignments of names and ``+`` chains, and a literal is
scored by how sensitive the name is that it reaches and by how random it looks. Plain patterns for well-known
forms give the base spans; the lexer's findings are added to them and never remove one.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from decimal import Decimal

from pyspark.sql import DataFrame

from .util import map_columns

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "literal")

ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")

OPERATOR = re.compile(r":=|=>|[=:]")
#: The name before an operator, read backwards from it.
NAME_BEFORE = re.compile(r"""[ \t]*["'\]]?([A-Za-z0-9_.\-]*[A-Za-z_])""")
TERM = re.compile(r"""[ \t]*(?:"((?:[^"\\\n]|\\.)*)"|'((?:[^'\\\n]|\\.)*)'|([^\s"'`,;(){}\[\]<>+]+))""")
PLUS = re.compile(r"\s*\+(?:\s|\\\r?\n)*")
#: What may follow a plus sign at the start of a line without going on the chain: the next assignment, in a patch.
ASSIGNED = re.compile(r"""(?:[\w.\-]+|"[^"\n]*"|'[^'\n]*')[ \t]*(?::=|=>|[=:])""")
SUBWORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: Weights of the parts of a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "key": 0.5, "api": 0.4, "access": 0.4, "private": 0.5, "auth": 0.5, "bearer": 0.6,
    "credential": 0.9, "credentials": 0.9, "signing": 0.5, "session": 0.3, "salt": 0.4, "cookie": 0.3,
}
#: Words that stand in for a secret and are none.
PLACEHOLDERS = ("example", "changeme", "placeholder", "xxxx", "your_", "dummy", "redacted", "none", "null", "true", "false")


def name_score(name: str) -> float:
    return min(1.5, sum(SENSITIVE.get(p.lower(), 0.0) for p in SUBWORD.findall(name.replace("apikey", "api_key"))))


class Chain:
    """Values in the order of their concatenation; parts are (start, end) of literals in the text, or chains that others hold too.

    A chain with a ``span`` is itself a literal, whose parts are pieces that other literals end with as well.
    """

    __slots__ = ("parts", "span", "known")

    def __init__(self, parts: list, span: tuple[int, int] | None = None):
        self.parts, self.span, self.known = parts, span, None

    def summary(self, text: str):
        """What a score needs of the whole value, however often it repeats: see ``summary_of``."""
        waiting = [self]
        while waiting:
            chain = waiting[-1]
            inner = [p for p in chain.parts if isinstance(p, Chain) and p.known is None] if chain.known is None else []
            if inner:
                waiting += inner
                continue
            waiting.pop()
            if chain.known is None:
                chain.known = joined(p.known if isinstance(p, Chain) else summary_of(text[slice(*p)]) for p in chain.parts)
        return self.known

    def spans(self, seen: set[int]):
        """(start, end) of the literals, each chain that is not in ``seen`` once."""
        waiting = [self]
        while waiting:
            chain = waiting.pop()
            if id(chain) in seen:
                continue
            seen.add(id(chain))
            if chain.span:
                yield chain.span
            else:
                waiting += (p for p in chain.parts if isinstance(p, Chain))
                yield from (p for p in chain.parts if not isinstance(p, Chain))


#: Characters at a value's ends that can belong to a placeholder across a joint, and lengths that are counted exactly.
REACH, EXACT = max(map(len, PLACEHOLDERS)) - 1, 10**15


def summary_of(value: str):
    """Length, counts of characters, lower-case start and end, and whether a placeholder is inside."""
    low = value.lower()
    return len(value), Counter(value), low[:REACH], low[-REACH:], any(p in low for p in PLACEHOLDERS)


def joined(summaries):
    """The summary of concatenated values; past ``EXACT`` counts keep 28 digits."""
    length, counts, head, tail, found = 0, {}, "", "", False
    for n, more, start, end, inside in summaries:
        length += n
        for c, k in more.items():
            counts[c] = counts.get(c, 0) + k
        found = found or inside or any(p in tail + start for p in PLACEHOLDERS)
        head, tail = (head + start)[:REACH], (tail + end)[-REACH:]
    if length > EXACT:
        length, counts = +Decimal(length), {c: +Decimal(k) for c, k in counts.items()}
    return length, counts, head, tail, found


def literal_score(length, counts, head, tail, found) -> float:
    """0 for placeholders, short or wordlike literals; else rises with entropy and length up to 1."""
    if length < 8 or found:
        return 0.0
    kinds = sum(any(map(k, counts)) for k in (re.compile(c).match for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))
    if kinds < 2 or " " in counts:
        return 0.0
    entropy = -sum(p * math.log2(p) for n in counts.values() if (p := float(n / length)))
    return max(0.0, min(1.0, (entropy - 1.5) / 2)) * min(1.0, float(length / 16) if length < 16 else 1.0)


class Lexer:
    """Reads the terms of a text's assignments, each place once, whatever number of operators lead to it.

    Operators inside a chain, as in ``x=a+y=b+c``, share its tail, and operators inside one term, as in ``x=y=z``, the
    term's end: a text costs as much as it is long. So a constant in a tail stands for what it was when the first chain
    read it.
    """

    def __init__(self, text: str):
        self.text, self.known, self.longest = text, {}, 0
        self.ends: dict[int, tuple[Chain, int]] = {}  # of the unquoted term read last, by where each literal begins in it
        self.tails: dict[int, Chain | None] = {}  # by the place behind a plus sign
        self.joint = (-1, None)  # where the term read last ended, and the tail behind it

    def name(self, name: str, chain: Chain) -> None:
        self.known[name], self.longest = chain, max(self.longest, len(name))

    def constant(self, start: int, end: int) -> Chain | None:
        """The chain of a name; a term with an operator in it is none."""
        return self.known.get(self.text[start:end]) if end - start <= self.longest else None

    def read(self, at: int) -> tuple[Chain, int] | None:
        """The literal or constant of the first term behind an operator, and where it ends."""
        if at not in self.ends:
            term = TERM.match(self.text, at)
            if not term:
                return None
            if term[3] is None:
                span = term.span(1 if term[1] is not None else 2)
                return Chain([span], span), term.end()
            start, end = term.span(3)
            cuts = [start, *(o.end() for o in OPERATOR.finditer(self.text, start, end) if o.end() < end)]
            self.ends, last = {}, None
            for cut, after in zip(reversed(cuts), [end, *reversed(cuts)], strict=False):
                last = Chain([(cut, after)] + [last] * (last is not None), (cut, end))
                self.ends[cut] = last, end
            self.ends[at] = self.ends[start]
        chain, end = self.ends[at]
        return (self.constant(*chain.span) if len(chain.parts) == 1 else None) or chain, end

    def tail(self, end: int) -> Chain | None:
        """The chain behind a term that ends there and a plus sign, if one follows."""
        if self.joint[0] != end:
            plus = PLUS.match(self.text, end)
            self.joint = end, self.walk(end, plus) if plus else None
        return self.joint[1]

    def walk(self, end: int, plus: re.Match) -> Chain | None:
        """Terms joined by plus signs up to the chain's end or a place that was read before.

        A chain crosses a line end after a plus sign, and before one where a quoted literal or a known name follows that is not
        assigned to itself, since lists and patches begin lines with a plus as well.
        """
        text, runs, parts, place = self.text, [], [], plus.end()
        while plus:
            at = plus.end()
            if at in self.tails:
                parts += [self.tails[at]] if self.tails[at] else []
                break
            term = TERM.match(text, at)
            if not term:
                break
            group = next(g for g in (1, 2, 3) if term[g] is not None)
            inner = OPERATOR.search(text, *term.span(3)) if group == 3 else None
            constant = self.constant(*term.span(3)) if group == 3 and not inner else None
            if "\n" in text[end : text.index("+", end)] and (group == 3 and not constant or ASSIGNED.match(text, at)):
                break
            parts.append(constant or term.span(group))
            end = term.end()
            plus = PLUS.match(text, end)
            if inner and plus:  # its operators begin chains that go on there
                runs.append((place, parts))
                parts, place = [], plus.end()
        runs.append((place, parts))
        after = None
        for place, parts in reversed(runs):
            parts += [after] if after else []
            after = self.tails[place] = Chain(parts) if parts else None
        return after

    def assignments(self):
        """(name, chain of literals) for each assignment, with constants followed to their literals."""
        text, before = self.text, 0  # where the last operator ended: no name crosses one, so names cost as much as the text has characters
        for op in OPERATOR.finditer(text):
            at, since, before = op.start(), before, op.end()
            if op[0] == "=" and (text[at - 1 : at] in ("=", "!", "<", ">", ":") or text[at + 1 : at + 2] in ("=", ">")):
                continue  # a comparison, or the end of a longer operator
            if op[0] == ":" and text[at + 1 : at + 3] == "//":
                continue
            name = NAME_BEFORE.match(text[since:at][::-1])
            first = self.read(op.end()) if name else None
            if first:
                tail = self.tail(first[1])
                chain = Chain([first[0], tail]) if tail else first[0]
                self.name(name[1][::-1], chain)
                yield name[1][::-1], chain


def find_secrets(text: str, threshold: float = 0.6) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and the literals that the lexer adds; spans are (kind, start, end) in code points."""
    base = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    base += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    base += [("hex", *m.span()) for m in HEX.finditer(text)]
    added, seen, kept = set(), set(), []
    for name, chain in Lexer(text).assignments():
        weight = name_score(name)
        if weight and weight * literal_score(*chain.summary(text)) >= threshold:
            kept.append(chain)  # an id in ``seen`` must not be given again
            added.update(("literal", start, end) for start, end in chain.spans(seen) if end > start)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    return sorted(base, key=order), sorted([*base, *added], key=order)


def join_spans(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Find secrets in every whole text: one narrow map over the scan.

    ``docs`` needs doc_id and text; other columns are ignored. Returns doc_id, n_assign, n_access, n_hex (base
    spans), n_literal (added spans), base_sha256 and spans. A null text is an empty one and has no spans; rows with
    equal or null ids are kept each; an empty table gives no rows.
    """

    def make():
        def run(doc_id, text):
            found = [find_secrets(t or "", threshold) for t in text]
            out = {f"n_{k}": [sum(s[0] == k for s in every) for _, every in found] for k in KINDS}
            return out | {"doc_id": doc_id, "base_sha256": [hashlib.sha256(join_spans(b).encode()).hexdigest() for b, _ in found], "spans": [join_spans(e) for _, e in found]}

        return run

    return map_columns(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, n_literal long, base_sha256 string, spans string", make)
