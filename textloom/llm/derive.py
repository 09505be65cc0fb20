"""Parsing with derivatives, memoised.

A grammar is a set of rules whose right sides are regular expressions over tokens and other rules. The derivative of a
right side by a symbol is again a right side, made once and kept. What is left of a whole text is a set of stacks of such
right sides; its derivative by a token is made once and kept as well, so that a grammar turns, as texts go by, into a
table that is followed one look-up per token. An empty derivative marks the token that fails; a text whose end derivative
is not nullable breaks off too early. Ambiguity is no error: a set may hold several stacks.

Rules may not be left-recursive.
"""

from __future__ import annotations

import re
from functools import lru_cache

_LEX = re.compile(r"\s+|'([^']+)'|([A-Za-z_]\w*)|([|()*+?;=])")

EMPTY, NEVER = ("eps",), ("never",)


def seq(a, b):
    if a is NEVER or b is NEVER:
        return NEVER
    if a is EMPTY:
        return b
    if b is EMPTY:
        return a
    return ("seq", a, b) if a[0] != "seq" else ("seq", a[1], seq(a[2], b))


def alt(parts):
    flat = set()
    for p in parts:
        if p is NEVER:
            continue
        flat |= p[1] if p[0] == "alt" else {p}
    if not flat:
        return NEVER
    return next(iter(flat)) if len(flat) == 1 else ("alt", frozenset(flat))


def star(a):
    return EMPTY if a is EMPTY or a is NEVER else a if a[0] == "star" else ("star", a)


def parse_rules(text: str) -> dict[str, tuple]:
    """Rules written as ``name = 'token' NAME (a | b)* c? ;``. Upper-case names and quoted texts are tokens. A rule given
    twice has both right sides."""
    tokens = [m.groups() for m in _LEX.finditer(text) if m.lastindex]
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else (None, None, None)

    def choice():
        nonlocal at
        parts = [chain()]
        while peek()[2] == "|":
            at += 1
            parts.append(chain())
        return alt(parts)

    def chain():
        nonlocal at
        out = []
        while peek() != (None, None, None) and peek()[2] not in ("|", ")", ";"):
            quoted, name, sign = peek()
            at += 1
            if sign == "(":
                item = choice()
                at += 1
            else:
                item = ("sym", quoted if quoted else name, bool(quoted) or name.isupper())
            while peek()[2] in ("*", "+", "?"):
                mark = peek()[2]
                at += 1
                item = star(item) if mark == "*" else seq(item, star(item)) if mark == "+" else alt([item, EMPTY])
            out.append(item)
        whole = EMPTY
        for item in reversed(out):
            whole = seq(item, whole)
        return whole

    rules: dict[str, tuple] = {}
    while at < len(tokens):
        name = tokens[at][1]
        at += 2
        right = choice()
        at += 1
        rules[name] = alt([rules[name], right]) if name in rules else right
    return rules


@lru_cache(maxsize=None)
def nullable(r) -> bool:
    kind = r[0]
    return kind in ("eps", "star") or kind == "seq" and nullable(r[1]) and nullable(r[2]) or kind == "alt" and any(map(nullable, r[1]))


@lru_cache(maxsize=None)
def derive(r, symbol: str):
    """What is left of a right side after a symbol."""
    kind = r[0]
    if kind == "sym":
        return EMPTY if r[1] == symbol else NEVER
    if kind == "seq":
        first = seq(derive(r[1], symbol), r[2])
        return alt([first, derive(r[2], symbol)]) if nullable(r[1]) else first
    if kind == "alt":
        return alt([derive(x, symbol) for x in r[1]])
    if kind == "star":
        return seq(derive(r[1], symbol), r)
    return NEVER


@lru_cache(maxsize=None)
def leading(r) -> frozenset:
    """Symbols that a right side may begin with, as (symbol, is it a token)."""
    kind = r[0]
    if kind == "sym":
        return frozenset([(r[1], r[2])])
    if kind == "seq":
        return leading(r[1]) | leading(r[2]) if nullable(r[1]) else leading(r[1])
    if kind == "alt":
        return frozenset().union(*map(leading, r[1]))
    return leading(r[1]) if kind == "star" else frozenset()


class Grammar:
    """A grammar with its table of derivatives. States are numbers; ``start`` gives the first for a rule, ``step`` the
    next one (0 where the derivative is empty), ``ends`` whether a text may end, ``takes`` whether a token may come."""

    #: Stacks and states that are kept before the table is begun anew; this changes no result.
    LIMIT = 400_000

    def __init__(self, text: str):
        self.rules = parse_rules(text)
        used = {s for r in self.rules.values() for s, token in self._symbols(r) if not token}
        if missing := used - set(self.rules):
            raise ValueError(f"rules that are not given: {sorted(missing)}")
        self.empty = {n: False for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, r in self.rules.items():
                if not self.empty[n] and self._empty(r):
                    self.empty[n] = changed = True
        self.first: dict[str, set] = {n: set() for n in self.rules}
        changed = True
        while changed:
            changed = False
            for n, r in self.rules.items():
                new = self._first(r) - self.first[n]
                if new:
                    self.first[n] |= new
                    changed = True
        self.forms: dict[tuple, tuple] = {}
        self.clear()

    @staticmethod
    def _symbols(r):
        if r[0] == "sym":
            yield r[1], r[2]
        elif r[0] == "alt":
            for x in r[1]:
                yield from Grammar._symbols(x)
        else:
            for x in r[1:]:
                yield from Grammar._symbols(x)

    def _empty(self, r) -> bool:
        kind = r[0]
        if kind == "sym":
            return not r[2] and self.empty[r[1]]
        return kind in ("eps", "star") or kind == "seq" and self._empty(r[1]) and self._empty(r[2]) or kind == "alt" and any(map(self._empty, r[1]))

    def _first(self, r) -> set:
        kind = r[0]
        if kind == "sym":
            return {r[1]} if r[2] else set(self.first[r[1]])
        if kind == "seq":
            return self._first(r[1]) | (self._first(r[2]) if self._empty(r[1]) else set())
        if kind == "alt":
            return set().union(*map(self._first, r[1]))
        return self._first(r[1]) if kind == "star" else set()

    def clear(self) -> None:
        self.stacks: dict[tuple, int] = {}
        self.nodes: list[tuple] = [None]
        self.states: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.table: list[dict] = [{}]
        self.flags: list = [None]
        self.age = getattr(self, "age", 0) + 1

    def full(self) -> bool:
        return len(self.nodes) > self.LIMIT

    def _form(self, r) -> tuple:
        """Of a right side: whether it may end, its tokens with what is left, its rules with what is left."""
        got = self.forms.get(r)
        if got is None:
            tokens, rules = {}, []
            for symbol, token in leading(r):
                left = derive(r, symbol)
                if token:
                    tokens[symbol] = left
                else:
                    rules.append((symbol, left))
            got = self.forms[r] = (nullable(r), tokens, tuple(rules))
        return got

    def _node(self, r, below: int) -> int:
        """A stack: right side ``r`` on top of stack ``below``. What is already used up does not stay on a stack."""
        while r is EMPTY and below:
            r, below = self.nodes[below]
        key = (r, below)
        number = self.stacks.get(key)
        if number is None:
            number = self.stacks[key] = len(self.nodes)
            self.nodes.append(key)
        return number

    def _state(self, nodes: frozenset) -> int:
        number = self.states.get(nodes)
        if number is None:
            number = self.states[nodes] = len(self.sets)
            self.sets.append(nodes)
            self.table.append({})
            self.flags.append(None)
        return number

    def start(self, rule: str) -> int:
        return self._state(frozenset([self._node(self.rules[rule], 0)]))

    def step(self, state: int, token: str) -> int:
        row = self.table[state]
        number = row.get(token)
        if number is None:
            out, seen, work = set(), set(), list(self.sets[state])
            while work:
                node = work.pop()
                if node in seen:
                    continue
                seen.add(node)
                r, below = self.nodes[node]
                ends, tokens, rules = self._form(r)
                left = tokens.get(token)
                if left is not None:
                    out.add(self._node(left, below))
                for rule, rest in rules:
                    if token in self.first[rule]:
                        work.append(self._node(self.rules[rule], self._node(rest, below)))
                    if self.empty[rule]:
                        work.append(self._node(rest, below))
                if ends and below:
                    work.append(below)
            number = row[token] = self._state(frozenset(out))
        return number

    def _reach(self, state: int):
        """Right sides on top after all that may end has ended or been passed over."""
        seen, work = set(), list(self.sets[state])
        while work:
            node = work.pop()
            if node in seen:
                continue
            seen.add(node)
            r, below = self.nodes[node]
            ends, tokens, rules = self._form(r)
            yield r, below, ends
            for rule, rest in rules:
                if self.empty[rule]:
                    work.append(self._node(rest, below))
            if ends and below:
                work.append(below)

    def ends(self, state: int) -> bool:
        return any(ends and not below for _, below, ends in self._reach(state))

    def takes(self, state: int) -> frozenset:
        """All tokens that may come."""
        out: set = set()
        for r, _, _ in self._reach(state):
            _, tokens, rules = self._form(r)
            out |= set(tokens)
            for rule, _ in rules:
                out |= self.first[rule]
        return frozenset(out)
