"""Memoised parsing with derivatives over token streams.

A grammar is a set of rules over token kinds. What may still follow is a language; reading a token replaces it by
its derivative. Languages are hash-consed and factored from the left, and every node remembers its derivatives,
so after a while most tokens cost one lookup. An empty derivative marks the first token that cannot stand where it
stands; a language that cannot be empty at the end of the input means that the text stops too early.

Grammar notation: `name = alternatives ;` with | for choice, juxtaposition for sequence, [x] for an optional part,
{x} for repetition, ( ) for grouping, 'x' for a token, UPPER for a token kind, and other words for rules. Rules
must not be left-recursive.
"""

from __future__ import annotations

import re

_MOST_NODES = 300_000


class Node:
    """An interned language. next holds the derivatives found so far."""

    __slots__ = ("op", "a", "b", "nullable", "next", "key")

    def __init__(self, op, a=None, b=None, nullable=False):
        self.op, self.a, self.b, self.nullable = op, a, b, nullable
        self.next: dict = {}


class Grammar:
    def __init__(self, text: str, start: str):
        self.table: dict = {}
        self.none = Node("none")
        self.empty = Node("empty", nullable=True)
        self.bodies: dict[str, Node] = {}
        self.refs: dict[str, Node] = {}
        self._read(text)
        self._settle()
        self.start = self.refs[start]

    # --- interning constructors
    def _make(self, op, a, b, nullable) -> Node:
        key = (op, a if isinstance(a, (str, frozenset)) else id(a), id(b))
        node = self.table.get(key)
        if node is None:
            node = self.table[key] = Node(op, a, b, nullable)
        return node

    def token(self, kind: str) -> Node:
        return self._make("token", kind, None, False)

    def seq(self, a: Node, b: Node) -> Node:
        if a is self.none or b is self.none:
            return self.none
        if a is self.empty:
            return b
        if b is self.empty:
            return a
        if a.op == "seq":
            return self.seq(a.a, self.seq(a.b, b))
        return self._make("seq", a, b, a.nullable and b.nullable)

    def alt(self, parts) -> Node:
        flat: dict[int, Node] = {}
        for p in parts:
            for q in p.a if p.op == "alt" else (p,):
                if q is not self.none:
                    flat[id(q)] = q
        if len(flat) > 1:
            heads: dict[int, list[Node]] = {}
            for q in flat.values():
                heads.setdefault(id(q.a) if q.op == "seq" else id(q), []).append(q)
            if len(heads) < len(flat):
                joined: dict[int, Node] = {}
                for group in heads.values():
                    if len(group) > 1:
                        head = next(q.a for q in group if q.op == "seq")
                        q = self.seq(head, self.alt([q.b if q.op == "seq" else self.empty for q in group]))
                    else:
                        q = group[0]
                    joined[id(q)] = q
                flat = joined
        if not flat:
            return self.none
        if len(flat) == 1:
            return next(iter(flat.values()))
        return self._make("alt", frozenset(flat.values()), None, any(q.nullable for q in flat.values()))

    def star(self, a: Node) -> Node:
        return self._make("star", a, None, True)

    # --- reading the notation
    def _read(self, text: str) -> None:
        words = re.findall(r"'[^']*'|[\w@]+|[=|\[\]{}();]", text)
        at = 0

        def choice():
            nonlocal at
            parts = [sequence()]
            while words[at] == "|":
                at += 1
                parts.append(sequence())
            return self.alt(parts)

        def sequence():
            nonlocal at
            out = []
            while words[at] not in "|])};":
                w = words[at]
                at += 1
                if w in "([{":
                    inner = choice()
                    at += 1
                    out.append(inner if w == "(" else self.alt([inner, self.empty]) if w == "[" else self.star(inner))
                elif w[0] == "'":
                    out.append(self.token(w[1:-1]))
                elif w.isupper() or w == "NONE":
                    out.append(self.none if w == "NONE" else self.token(w))
                else:
                    out.append(self._ref(w))
            node = self.empty
            for part in reversed(out):
                node = self.seq(part, node)
            return node

        while at < len(words):
            name = words[at]
            at += 2
            self._ref(name)
            self.bodies[name] = choice()
            at += 1

    def _ref(self, name: str) -> Node:
        if name not in self.refs:
            self.refs[name] = Node("rule", name)
        return self.refs[name]

    def _settle(self) -> None:
        """Which rules may be empty: the least fixed point, then carried into the nodes that were built before."""
        missing = set(self.refs) - set(self.bodies)
        if missing:
            raise ValueError(f"no rule for {sorted(missing)}")

        def nullable(n: Node) -> bool:
            if n.op == "rule":
                return n.nullable
            if n.op == "seq":
                return nullable(n.a) and nullable(n.b)
            if n.op == "alt":
                return any(nullable(q) for q in n.a)
            return n.nullable

        changed = True
        while changed:
            changed = False
            for name, body in self.bodies.items():
                if not self.refs[name].nullable and nullable(body):
                    self.refs[name].nullable = changed = True
        for n in self.table.values():
            n.nullable = nullable(n)

    # --- derivatives
    def derive(self, node: Node, kind: str) -> Node:
        known = node.next.get(kind)
        if known is not None:
            return known
        op = node.op
        if op == "token":
            out = self.empty if node.a == kind else self.none
        elif op == "seq":
            out = self.seq(self.derive(node.a, kind), node.b)
            if node.a.nullable:
                out = self.alt([out, self.derive(node.b, kind)])
        elif op == "alt":
            out = self.alt([self.derive(q, kind) for q in node.a])
        elif op == "star":
            out = self.seq(self.derive(node.a, kind), node)
        elif op == "rule":
            out = self.derive(self.bodies[node.a], kind)
        else:
            out = self.none
        node.next[kind] = out
        return out

    def forget(self) -> None:
        """Drop remembered derivatives once they take too much room; rules and their bodies stay."""
        if len(self.table) <= _MOST_NODES:
            return
        keep: dict = {}

        def walk(n: Node):
            if id(n) in keep:
                return
            keep[id(n)] = n
            n.next = {}
            for child in (n.a if n.op == "alt" else (n.a, n.b)):
                if isinstance(child, Node):
                    walk(child)

        for n in [*self.bodies.values(), *self.refs.values(), self.none, self.empty]:
            walk(n)
        self.table = {k: n for k, n in self.table.items() if id(n) in keep}

    def parse(self, tokens) -> tuple[str, int]:
        """("valid" | "failed" | "truncated", number of tokens read).

        tokens yields (kind, newline before it, place). A token kind `ASI` in the grammar stands for a statement end
        that may be left out before a line break, a closing brace or the end; kind `!` forces it.
        """
        state, none, n = self.start, self.none, 0
        for kind, newline in tokens:
            n += 1
            after = state.next.get(kind)
            if after is None:
                after = self.derive(state, kind)
            if after is none:
                if kind == "!":
                    continue
                if newline or kind == "}":
                    ended = self.derive(state, "ASI")
                    after = self.derive(ended, kind) if ended is not none else none
                if after is none:
                    return "failed", n
            state = after
        if state.nullable or self.derive(state, "ASI").nullable:
            return "valid", n
        return "truncated", n
