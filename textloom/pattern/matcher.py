"""A backtracking matcher with memory, for constructs that no other engine here has.

A syntax tree becomes a graph of steps; a match walks it with an explicit stack of untried choices, so
that long texts need no recursion. Positions are code points. A choice that has failed at a position
is not tried there again (as in the memoised backtracking of arXiv:2401.12639), which bounds the work
by pattern times text, unless the pattern has references, conditions or calls, whose outcome depends
on more than the position. Lookbehinds are walked from right to left.
"""

from __future__ import annotations

import re

from textloom.pattern import charset as C
from textloom.pattern.analyze import begins_with, first, group_of, has, width
from textloom.pattern.charset import CharSet
from textloom.pattern.emit import ahead, class_text
from textloom.pattern.parse import Absent, Alt, Anchor, Atomic, Backref, Call, Cat, Char, Cond, Group, Keep, Look, Node, Parsed, PatternError, Rep, Set

CALL_DEPTH = 200
NESTING = 100
MOST_STEPS = 50_000

(END, SET, TEXT, FOLD, MULTI, RUN, SPLIT, SAVE, KEEP, ANCHOR, BACKREF, LOOK, ATOMIC, ABSENT, CALL, RETURN, COND, ENTER, LEAVE, FAIL) = range(20)


class Matcher:
    """The compiled form; picklable, so that it can travel to tasks."""

    def __init__(self, parsed: Parsed):
        self.root, self.groups = parsed.root, parsed.groups
        self.steps: list[tuple] = [(END,)]
        self.word = C.word()
        self.calls: dict[tuple[int, bool], int] = {}
        self.loops = 0
        self.start = self.build(parsed.root, 0, False)
        self.memo = not has(parsed.root, Backref, Cond, Call)
        f, empty = first(parsed.root)
        self.at_search, self.at_text = begins_with(parsed.root, "G"), begins_with(parsed.root, "A")
        self.first_class = None if self.at_search or self.at_text or empty or width(parsed.root)[0] == 0 or f == C.ANY else class_text(f, "re")
        self.ahead = None if self.first_class is None else ahead(parsed.root)
        self._scan = self._ahead = self._text = None

    def __getstate__(self):
        return self.__dict__ | {"_scan": None, "_ahead": None, "_text": None}

    # -- building: each function returns the step to begin with, given the step that follows
    def add(self, *step) -> int:
        if len(self.steps) > MOST_STEPS:
            raise PatternError("the pattern is too large")
        self.steps.append(step)
        return len(self.steps) - 1

    def build(self, node: Node, after: int, back: bool) -> int:
        if isinstance(node, Char):
            return self.add(FOLD, C.fold(node.cp), back, after) if node.icase else self.add(TEXT, chr(node.cp), back, after)
        if isinstance(node, Set):
            if node.multi:
                positive = ~node.chars if node.negated else node.chars
                return self.add(MULTI, positive, node.multi, node.negated, back, after)
            return self.add(SET, node.chars, back, after)
        if isinstance(node, Cat):
            runs = self.joined(node.items)
            for x in runs if back else reversed(runs):
                after = self.build(x, after, back) if isinstance(x, Node) else self.add(x[0], x[1], back, after)
            return after
        if isinstance(node, Alt):
            at = self.build(node.items[-1], after, back)
            for x in reversed(node.items[:-1]):
                at = self.add(SPLIT, self.build(x, after, back), at)
            return at
        if isinstance(node, Rep):
            return self.repeat(node, after, back)
        if isinstance(node, Group):
            a, b = (2 * node.index, 2 * node.index + 1) if not back else (2 * node.index + 1, 2 * node.index)
            return self.add(SAVE, a, self.build(node.item, self.add(SAVE, b, after), back))
        if isinstance(node, Atomic):
            return self.add(ATOMIC, self.build(node.item, 0, back), has(node.item, Group), after)
        if isinstance(node, Look):
            if node.behind and has(node.item, Absent):
                raise PatternError("an absence operator in a lookbehind")
            return self.add(LOOK, self.build(node.item, 0, node.behind), node.negative, has(node.item, Group), after)
        if isinstance(node, Absent):
            if back:
                raise PatternError("an absence operator in a lookbehind")
            return self.add(ABSENT, self.build(node.item, 0, False), after)
        if isinstance(node, Anchor):
            return self.add(ANCHOR, node.kind, after)
        if isinstance(node, Keep):
            return self.add(KEEP, after)
        if isinstance(node, Backref):
            return self.add(BACKREF, node.index, node.icase, back, after) if node.index <= self.groups else self.add(FAIL)
        if isinstance(node, Call):
            return self.add(CALL, self.routine(node.index, back), after)
        if isinstance(node, Cond):
            return self.add(COND, node.index, self.build(node.yes, after, back), self.build(node.no, after, back))
        raise PatternError(f"unknown construct {node!r}")

    @staticmethod
    def joined(items: tuple[Node, ...]) -> list:
        """Neighbouring characters as one text, or as one folded text."""
        out: list = []
        for x in items:
            if isinstance(x, Char):
                kind, text = (FOLD, C.fold(x.cp)) if x.icase else (TEXT, chr(x.cp))
                if out and isinstance(out[-1], tuple) and out[-1][0] == kind:
                    out[-1] = (kind, out[-1][1] + text)
                else:
                    out.append((kind, text))
            else:
                out.append(x)
        return out

    def routine(self, index: int, back: bool) -> int:
        """The steps of a called group, which end with a return; made once, so it may call itself."""
        key = (index, back)
        if key not in self.calls:
            self.calls[key] = at = self.add(FAIL)
            node = self.root if index == 0 else group_of(self.root, index)
            self.steps[at] = (SPLIT, self.build(node, self.add(RETURN), back), None)
        return self.calls[key]

    def repeat(self, node: Rep, after: int, back: bool) -> int:
        item, low, high = node.item, node.low, node.high
        chars = item.chars if isinstance(item, Set) and not item.multi else CharSet([(item.cp, item.cp)]) if isinstance(item, Char) and not item.icase else None
        if chars is not None:
            if node.kind == "possessive" and low and (high is None or high > low):
                rest = self.add(RUN, chars, 0, None if high is None else high - low, "possessive", back, after)
                return self.add(RUN, chars, low, low, "greedy", back, rest)
            return self.add(RUN, chars, low, high, node.kind, back, after)
        if node.kind == "possessive":
            rest = Atomic(Rep(item, 0, None if high is None else high - low, "greedy"))
            return self.build(Rep(item, low, low, "greedy"), self.build(rest, after, back), back) if low else self.build(rest, after, back)
        at = after
        if high is None:
            at = self.loop(item, after, node.kind == "lazy", back)
        else:
            for _ in range(high - low):
                body = self.build(item, at, back)
                at = self.add(SPLIT, after, body) if node.kind == "lazy" else self.add(SPLIT, body, after)
        for _ in range(low):
            at = self.build(item, at, back)
        return at

    def loop(self, item: Node, after: int, lazy: bool, back: bool) -> int:
        head = self.add(FAIL)
        if width(item)[0] == 0:
            self.loops += 1
            body = self.add(ENTER, self.loops, self.build(item, self.add(LEAVE, self.loops, head, after), back))
        else:
            body = self.build(item, head, back)
        self.steps[head] = (SPLIT, after, body) if lazy else (SPLIT, body, after)
        return head

    # -- running
    def scan(self, text: str) -> re.Pattern | None:
        """What finds the places of a text where a match may begin."""
        if self.first_class is None:
            return None
        if self._scan is None:
            self._scan = re.compile(self.first_class)
            self._ahead = self.ahead and [re.compile(x) for x in self.ahead]
        if self._ahead is None:
            return self._scan
        if self._text is None or self._text[0] is not text:
            self._text = text, self._scan if self._ahead[1].search(text) else self._ahead[0]
        return self._text[1]

    def search(self, text: str, pos: int = 0):
        """The leftmost match from pos on: (start, end, slots) or None; slots has start and end of each
        group by twice its number, None where unset. What stands before pos is seen by look-behinds."""
        state = _State(self, text, pos)
        n = len(text)
        scan = self.scan(text)
        empty = (None,) * (2 * self.groups + 2)
        at = pos
        last = min(n, pos) if self.at_search else 0 if self.at_text else n
        while at <= last:
            if scan is not None:
                hit = scan.search(text, at)
                if hit is None:
                    return None
                at = hit.start()
            got = state.run(self.start, at, empty, None, state.tried, 0)
            if got is not None:
                end, slots, keep = got
                return (at if keep is None else keep), end, slots
            at += 1
        return None


class _State:
    def __init__(self, m: Matcher, text: str, origin: int):
        self.m, self.text, self.origin = m, text, origin
        self.tried: set = set()
        self.failed: set = set()
        self.ends: dict = {}

    def folded(self, pos: int, want: str, back: bool) -> int | None:
        """Where text that folds to `want` ends, from pos on (or before pos)."""
        text, at, left = self.text, pos, want
        if back:
            while left:
                if at == 0:
                    return None
                at -= 1
                f = C.fold(ord(text[at]))
                if not left.endswith(f):
                    return None
                left = left[: -len(f)]
            return at
        while left:
            if at >= len(text):
                return None
            f = C.fold(ord(text[at]))
            if not left.startswith(f):
                return None
            left = left[len(f) :]
            at += 1
        return at

    def anchor(self, kind: str, pos: int) -> bool:
        text, n = self.text, len(self.text)
        if kind == "^":
            return pos == 0 or text[pos - 1] == "\n"
        if kind == "$":
            return pos == n or text[pos] == "\n"
        if kind == "A":
            return pos == 0
        if kind == "z":
            return pos == n
        if kind == "Z":
            return pos == n or pos == n - 1 and text[pos] == "\n"
        if kind == "G":
            return pos == self.origin
        w = self.m.word
        edge = (pos > 0 and ord(text[pos - 1]) in w) != (pos < n and ord(text[pos]) in w)
        return edge == (kind == "b")

    def sub(self, entry: int, pos: int, slots: tuple, captures: bool, depth: int):
        """A body that is matched on its own: its first way to match, or None."""
        if depth >= NESTING:
            return None
        if not self.m.memo:
            return self.run(entry, pos, slots, None, None, depth + 1)
        if (entry, pos) in self.failed:
            return None
        if not captures and (entry, pos) in self.ends:
            return self.ends[entry, pos], slots, None
        got = self.run(entry, pos, slots, None, set(), depth + 1)
        if got is None:
            self.failed.add((entry, pos))
        elif not captures:
            self.ends[entry, pos] = got[0]
        return got

    def shortest(self, entry: int, pos: int, slots: tuple, depth: int, most: int) -> int | None:
        """The least end of any match of a body that starts at pos, if it is at most `most`."""
        best = None
        for end in self.run(entry, pos, slots, None, set() if self.m.memo else None, depth + 1, True):
            if end <= most and (best is None or end < best):
                best = end
        return best

    def absence(self, entry: int, pos: int, slots: tuple, depth: int) -> int | None:
        """The last end up to which the body matches nowhere; None if it matches the empty text."""
        limit, start = len(self.text), pos
        while start <= limit:
            end = self.shortest(entry, start, slots, depth, limit)
            if end is not None:
                limit = end - 1
            start += 1
        return limit if limit >= pos else None

    def run(self, entry: int, pos: int, slots: tuple, calls, tried: set | None, depth: int, every: bool = False):
        """The first match from a step on: (end, slots, kept start), or None. With `every`, all ends."""
        steps, text, n = self.m.steps, self.text, len(self.text)
        stack: list[tuple] = []
        pc, keep, nulls, level = entry, None, (), 0
        ends: set[int] = set()
        while True:
            step = steps[pc]
            op = step[0]
            ok = True
            if op == TEXT:
                _, s, back, pc = step
                if back:
                    ok = pos >= len(s) and text.startswith(s, pos - len(s))
                    pos -= len(s)
                else:
                    ok = text.startswith(s, pos)
                    pos += len(s)
            elif op == SET:
                _, s, back, pc = step
                if back:
                    pos -= 1
                    ok = pos >= 0 and ord(text[pos]) in s
                else:
                    ok = pos < n and ord(text[pos]) in s
                    pos += 1
            elif op == SPLIT:
                if step[2] is None:
                    pc = step[1]
                    continue
                if tried is not None:
                    key = (pc, pos, nulls)
                    if key in tried:
                        ok = False
                    else:
                        tried.add(key)
                if ok:
                    stack.append((step[2], pos, slots, keep, nulls, calls, level, None))
                    pc = step[1]
            elif op == RUN:
                _, s, low, high, kind, back, after = step
                at, most, got = pos, n if high is None else high, 0
                want = low if kind == "lazy" else most
                if back:
                    while got < want and at > 0 and ord(text[at - 1]) in s:
                        at -= 1
                        got += 1
                else:
                    while got < want and at < n and ord(text[at]) in s:
                        at += 1
                        got += 1
                ok = got >= low
                if ok and tried is not None and kind != "possessive" and low != high:
                    key = (pc, pos, nulls)
                    if key in tried:
                        ok = False
                    else:
                        tried.add(key)
                if ok:
                    if kind == "greedy" and got > low:
                        stack.append((after, at, slots, keep, nulls, calls, level, (got - 1, low, 1 if back else -1)))
                    elif kind == "lazy" and got < most:
                        stack.append((pc, at, slots, keep, nulls, calls, level, (got, most, s, back, after)))
                    pos, pc = at, after
            elif op == FOLD:
                _, s, back, pc = step
                at = self.folded(pos, s, back)
                ok, pos = at is not None, at
            elif op == MULTI:
                _, s, multi, negated, back, pc = step
                at = next((e for m in multi if (e := self.folded(pos, m, back)) is not None), None)
                here = pos - 1 if back else pos
                inside = 0 <= here < n
                if negated:
                    ok = at is None and inside and ord(text[here]) not in s
                    pos = here if back else pos + 1
                elif at is not None:
                    pos = at
                else:
                    ok = inside and ord(text[here]) in s
                    pos = here if back else pos + 1
            elif op == SAVE:
                _, i, pc = step
                slots = (*slots[:i], pos, *slots[i + 1 :])
            elif op == KEEP:
                keep, pc = pos, step[1]
            elif op == ANCHOR:
                ok, pc = self.anchor(step[1], pos), step[2]
            elif op == BACKREF:
                _, i, icase, back, pc = step
                a, b = slots[2 * i], slots[2 * i + 1]
                if a is None or b is None:
                    ok = False
                elif icase:
                    at = self.folded(pos, "".join(C.fold(ord(c)) for c in text[a:b]), back)
                    ok, pos = at is not None, at
                elif back:
                    ok = pos >= b - a and text.startswith(text[a:b], pos - (b - a))
                    pos -= b - a
                else:
                    ok = text.startswith(text[a:b], pos)
                    pos += b - a
            elif op == ATOMIC:
                got = self.sub(step[1], pos, slots, step[2], depth)
                ok, pc = got is not None, step[3]
                if ok:
                    pos, slots = got[0], got[1]
                    keep = got[2] if got[2] is not None else keep
            elif op == LOOK:
                _, body, negative, captures, pc = step
                got = self.sub(body, pos, slots, captures and not negative, depth)
                ok = (got is None) == negative
                if ok and got is not None:
                    slots = got[1]
            elif op == ABSENT:
                _, body, after = step
                limit = self.absence(body, pos, slots, depth) if depth < NESTING else None
                ok = limit is not None
                if ok:
                    if limit > pos:
                        stack.append((after, limit, slots, keep, nulls, calls, level, (limit - pos - 1, 0, -1)))
                    pos, pc = limit, after
            elif op == CALL:
                ok = level < CALL_DEPTH
                calls, level, pc = (step[2], calls), level + 1, step[1]
            elif op == RETURN:
                pc, calls = calls
                level -= 1
            elif op == COND:
                pc = step[2] if slots[2 * step[1]] is not None and slots[2 * step[1] + 1] is not None else step[3]
            elif op == ENTER:
                nulls, pc = (*nulls, pos), step[2]
            elif op == LEAVE:
                began, nulls = nulls[-1], nulls[:-1]
                pc = step[3] if began == pos else step[2]
            elif op == END:
                if not every:
                    return pos, slots, keep
                ends.add(pos)
                ok = False
            else:
                ok = False
            while not ok:
                if not stack:
                    return ends if every else None
                pc, pos, slots, keep, nulls, calls, level, more = stack.pop()
                ok = True
                if more is None:
                    break
                if len(more) == 3:  # a greedy run gives back one
                    got, low, move = more
                    pos += move
                    if got > low:
                        stack.append((pc, pos, slots, keep, nulls, calls, level, (got - 1, low, move)))
                else:  # a lazy run takes one more
                    got, most, s, back, after = more
                    here = pos - 1 if back else pos
                    if not (0 <= here < n and ord(text[here]) in s):
                        ok = False
                        continue
                    pos = here if back else pos + 1
                    if got + 1 < most:
                        stack.append((pc, pos, slots, keep, nulls, calls, level, (got + 1, most, s, back, after)))
                    pc = after
