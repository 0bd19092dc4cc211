"""Table generator and drivers for context-free grammars.

``load(name)`` turns a bundled grammar file into LALR(1) tables.  Two drivers
use them: :func:`parse`, the deterministic one, which takes the action a
precedence declaration chose; and :func:`parse_all`, a generalised driver which
follows every action of a conflicting cell and every class of an ambiguous
token, and therefore says whether *any* reading of the tokens is a sentence.

Grammar files hold one rule after another::

    %left + -            precedence, loosest first; also %right, %nonassoc
    sum : sum + sum      a rule; further alternatives start with |
        | NUM
        |                an alternative without symbols is the empty one

A symbol is a terminal unless it is the left side of some rule.  The first rule
is the start rule, ``%start a b`` names several start symbols instead.
"""

from __future__ import annotations

from functools import cache
from importlib import resources

END = "$end"


class Tables:
    """LALR(1) tables: plain dicts and lists, so they pickle into a broadcast."""

    __slots__ = ("accept", "action", "chains", "goto", "lhs", "more", "names", "size", "start", "terminals")

    def __init__(self, action, more, goto, lhs, size, start, accept, terminals, names):
        self.action, self.more, self.goto = action, more, goto
        self.lhs, self.size, self.start, self.accept = lhs, size, start, accept
        self.terminals, self.names = terminals, names
        self.chains: dict[tuple[int, int, int], int] = {}  # (state below, symbol, token) -> state after a chain of unit rules

    def __getstate__(self):
        return tuple(getattr(self, k) for k in self.__slots__)

    def __setstate__(self, state):
        for k, v in zip(self.__slots__, state):
            setattr(self, k, v)


def read_grammar(text: str):
    rules: list[tuple[str, tuple[str, ...], str | None]] = []
    prec: dict[str, tuple[int, str]] = {}
    starts: list[str] = []
    level, left = 0, None
    for raw in text.splitlines():
        line = raw.split("##")[0].strip()
        if not line:
            continue
        words = line.split()
        if words[0] in ("%left", "%right", "%nonassoc"):
            level += 1
            prec |= {w: (level, words[0][1:]) for w in words[1:]}
            continue
        if words[0] == "%start":
            starts = words[1:]
            continue
        if len(words) > 1 and words[1] == ":":
            left, words = words[0], words[2:]
        elif words[0] == "|":
            words = words[1:]
        mark = None
        if "%prec" in words:
            at = words.index("%prec")
            mark, words = words[at + 1], words[:at]
        rules.append((left, tuple(words), mark))
    return rules, prec, starts or [rules[0][0]]


def build(text: str) -> Tables:
    rules, prec, starts = read_grammar(text)
    top = [(f"$start-{s}", (s, END), None) for s in starts]
    rules = top + rules
    left_sides = dict.fromkeys(r[0] for r in rules)
    of: dict[str, list[int]] = {n: [] for n in left_sides}
    for i, (lhs, _, _) in enumerate(rules):
        of[lhs].append(i)
    terminals = list(dict.fromkeys(s for _, rhs, _ in rules for s in rhs if s not in of))
    tid = {t: i for i, t in enumerate(terminals)}
    nid = {n: i for i, n in enumerate(left_sides)}

    empty: set[str] = set()
    first: dict[str, set[str]] = {n: set() for n in of} | {t: {t} for t in terminals}
    changed = True
    while changed:
        changed = False
        for lhs, rhs, _ in rules:
            before = len(first[lhs]), lhs in empty
            for s in rhs:
                first[lhs] |= first[s]
                if s not in empty:
                    break
            else:
                empty.add(lhs)
            changed |= before != (len(first[lhs]), lhs in empty)

    def first_of(symbols) -> tuple[set[str], bool]:
        out: set[str] = set()
        for s in symbols:
            out |= first[s]
            if s not in empty:
                return out, False
        return out, True

    closures: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def closure0(kernel):
        items, seen, todo = list(kernel), set(), list(kernel)
        while todo:
            r, d = todo.pop()
            rhs = rules[r][1]
            if d < len(rhs) and rhs[d] in of and rhs[d] not in seen:
                seen.add(rhs[d])
                new = [(i, 0) for i in of[rhs[d]]]
                items += [x for x in new if x not in kernel]
                todo += new
        return items

    states: list[frozenset] = []
    index: dict[frozenset, int] = {}
    moves: list[dict[str, int]] = []

    def state(kernel) -> int:
        k = frozenset(kernel)
        if k not in index:
            index[k] = len(states)
            states.append(k)
            moves.append({})
        return index[k]

    start_states = {s: state({(i, 0)}) for i, s in enumerate(starts)}
    n = 0
    while n < len(states):
        by: dict[str, list] = {}
        for r, d in closure0(states[n]):
            rhs = rules[r][1]
            if d < len(rhs) and rhs[d] != END:
                by.setdefault(rhs[d], []).append((r, d + 1))
        for s, kernel in by.items():
            moves[n][s] = state(kernel)
        n += 1

    # Lookaheads: closure of each kernel item with a probe tells which are made here and which are handed on.
    def closure1(item, probe):
        out: dict[tuple[int, int], set[str]] = {item: {probe}}
        todo = [item]
        while todo:
            r, d = todo.pop()
            rhs = rules[r][1]
            if d >= len(rhs) or rhs[d] not in of:
                continue
            follow, through = first_of(rhs[d + 1 :])
            give = follow | out[(r, d)] if through else follow
            for i in of[rhs[d]]:
                have = out.setdefault((i, 0), set())
                if not give <= have:
                    have |= give
                    todo.append((i, 0))
        return out

    ahead: list[dict[tuple[int, int], set[str]]] = [{k: set() for k in s} for s in states]
    links: dict[tuple[int, tuple[int, int]], list[tuple[int, tuple[int, int]]]] = {}
    memo: dict[tuple[int, int], dict] = {}
    for i in range(len(starts)):
        ahead[start_states[starts[i]]][(i, 0)].add(END)
    for n, kernel in enumerate(states):
        for item in kernel:
            if item not in memo:
                memo[item] = closure1(item, "#")
            for (r, d), las in memo[item].items():
                rhs = rules[r][1]
                if d < len(rhs) and rhs[d] != END:
                    to, target = moves[n][rhs[d]], (r, d + 1)
                    ahead[to][target] |= las - {"#"}
                    if "#" in las:
                        links.setdefault((n, item), []).append((to, target))
    todo = [(n, item) for n, k in enumerate(states) for item in k if ahead[n][item]]
    while todo:
        n, item = todo.pop()
        for to, target in links.get((n, item), ()):
            if not ahead[n][item] <= ahead[to][target]:
                ahead[to][target] |= ahead[n][item]
                todo.append((to, target))

    def strength(r: int):
        _, rhs, mark = rules[r]
        if mark:
            return prec.get(mark)
        return next((prec[s] for s in reversed(rhs) if s in prec), None)

    action: list[dict[int, int]] = []
    more: dict[tuple[int, int], list[int]] = {}
    goto: list[dict[int, int]] = []
    for n, kernel in enumerate(states):
        row: dict[str, list[int]] = {}
        for s, to in moves[n].items():
            if s not in of:
                row[s] = [to + 1]
        done: dict[int, set[str]] = {}
        for item in kernel:
            for (r, d), las in memo[item].items():
                if d == len(rules[r][1]):
                    done.setdefault(r, set()).update((las - {"#"}) | (ahead[n][item] if "#" in las else set()))
        for r in sorted(done):
            for t in done[r]:
                have = row.setdefault(t, [])
                if have and have[0] > 0 and (p := strength(r)) and t in prec:
                    q = prec[t]
                    if p[0] > q[0] or (p[0] == q[0] and p[1] == "left"):
                        row[t] = [-r - 1]
                    elif p[0] == q[0] and p[1] == "nonassoc":
                        row[t] = []
                    continue
                have.append(-r - 1)
        for i in range(len(starts)):
            if (i, 1) in kernel:
                row.setdefault(END, []).append(0)
        action.append({tid[t]: a[0] for t, a in row.items() if a})
        more |= {(n, tid[t]): a for t, a in row.items() if len(a) > 1}
        goto.append({nid[s]: to for s, to in moves[n].items() if s in of})
    return Tables(action, more, goto, [nid[r[0]] for r in rules], [len(r[1]) for r in rules], start_states, 0, tid, terminals)


@cache
def load(name: str) -> Tables:
    return build(resources.files(__package__).joinpath("grammars", f"{name}.grammar").read_text())


def parse(t: Tables, tokens, start: str | None = None) -> int:
    """Index of the first token that no action takes, or -1 if the tokens (the last is END) are a sentence."""
    action, goto, lhs, size, chains = t.action, t.goto, t.lhs, t.size, t.chains
    s = t.start[start] if start else 0
    stack = [s]
    i, end = 0, len(tokens)
    while i < end:
        tok = tokens[i]
        a = action[s].get(tok)
        while a is not None and a < 0:
            n = size[-a - 1]
            if n:
                del stack[-n:]
            key = (stack[-1], lhs[-a - 1], tok)
            s = chains.get(key)
            if s is None:  # unit rules in a row replace the top state only; what is left of them is remembered
                base, s = key[0], goto[key[0]][key[1]]
                while (a := action[s].get(tok)) is not None and a < 0 and size[-a - 1] == 1:
                    s = goto[base][lhs[-a - 1]]
                chains[key] = s
            stack.append(s)
            a = action[s].get(tok)
        if a is None:
            return i
        if a == 0:
            return -1
        s = a - 1
        stack.append(s)
        i += 1
    return end


def parse_all(t: Tables, tokens, classes: dict[int, tuple[int, ...]], start: str | None = None) -> int:
    """Like :func:`parse`, over all readings: ``classes`` gives the terminals an ambiguous token may be.

    Stacks are shared linked cells; equal (state, parent) cells merge, so the number of live stacks stays small.
    """
    action, more, goto, lhs, size = t.action, t.more, t.goto, t.lhs, t.size
    root = (t.start[start] if start else 0, None)
    heads = {root}
    for i, token in enumerate(tokens):
        after = set()
        for tok in classes.get(token, (token,)):
            todo, seen = list(heads), set(heads)
            while todo:
                cell = todo.pop()
                s = cell[0]
                acts = more.get((s, tok)) or ((action[s][tok],) if tok in action[s] else ())
                for a in acts:
                    if a == 0:
                        return -1
                    if a > 0:
                        after.add((a - 1, cell))
                        continue
                    base = cell
                    for _ in range(size[-a - 1]):
                        base = base[1]
                    new = (goto[base[0]][lhs[-a - 1]], base)
                    if new not in seen:
                        seen.add(new)
                        todo.append(new)
        if not after:
            return i
        heads = after
    return len(tokens)
