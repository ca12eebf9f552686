"""Prefix dynamic programming over byte-pair vocabularies.

For every prefix of a piece there is exactly one token that can end its encoding: the
token t, a suffix of the prefix, that is compatible with the last token of what stands
before it. Storing this token for each prefix makes appending exact (what is stored
stays valid) and lets an edit be re-encoded from the prefix before it.
"""

from __future__ import annotations

import ahocorasick

#: Stands for nothing before a token, and for a symbol that is no token and never merges.
NONE = -1


class PrefixTable:
    """tokens: text -> merge priority (lower merges first; among equals the leftmost).

    Texts are str; byte vocabularies come as Latin-1, a character for each byte. A table
    holds, for each prefix, the number of its last token.
    """

    MEMO = 1 << 19  # entries; beyond that the memo starts anew, which only costs time

    def __init__(self, tokens: dict[str, int]) -> None:
        self.text = list(tokens)
        self.size = list(map(len, self.text))
        self.rank = tokens
        self.longest = max(self.size, default=1)
        self.find = ahocorasick.Automaton()
        for n, text in enumerate(self.text):
            self.find.add_word(text, n)
        self.find.make_automaton()
        self.number = {text: n for n, text in enumerate(self.text)}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.memo: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """The plain merge loop; only single tokens come here."""
        parts = list(text)
        while len(parts) > 2:
            best = min(((r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None), default=None)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    def _halves(self, n: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes token n; None for a token that no merging makes."""
        if n not in self.halves:
            parts = self._merged(self.text[n])
            known = len(parts) == 2 and all(p in self.number for p in parts)
            self.halves[n] = (self.number[parts[0]], self.number[parts[1]]) if known else None
        return self.halves[n]

    def _made(self, n: int) -> bool:
        return self.size[n] == 1 or self._halves(n) is not None

    def _holds(self, left: int, right: int) -> bool:
        """Whether the border between two tokens outlives all merges.

        Merges are undone from the latest on; at each step the two tokens at the border
        have stood side by side until then, so they must not have merged earlier.
        """
        rank, text, until = self.rank, self.text, float("inf")
        while True:
            joint = rank.get(text[left] + text[right])
            if joint is not None and joint < until:
                return False
            a = rank[text[left]] if self.size[left] > 1 else None
            b = rank[text[right]] if self.size[right] > 1 else None
            if a is None and b is None:
                return True
            if b is None or (a is not None and a > b):
                until, left = a, self._halves(left)[1]  # that merge, further left, goes before an equal one here
            else:
                until, right = b + 0.5, self._halves(right)[0]  # and this one, further right, behind it

    def compatible(self, before: int, token: int) -> bool:
        return self._made(token) and (before == NONE or self._holds(before, token))

    def extend(self, last: list[int], piece: str) -> list[int]:
        """last[i]: the last token of piece[: i + 1]; grown to the whole of piece.

        What is there already must belong to the same beginning of piece.
        """
        size, memo, done = self.size, self.memo, len(last)
        high = [0, *((n + 1) << 24 for n in last)]  # the upper half of a memo key
        for end, n in self.find.iter(piece, max(0, done - self.longest + 1)):
            if end == done or end > done and (self._skip(high, end - done) or (done := end) == end):
                key = high[end + 1 - size[n]] | n
                good = memo.get(key)
                if good is None:
                    if len(memo) >= self.MEMO:
                        memo.clear()
                    good = memo[key] = self.compatible((key >> 24) - 1, n)
                if good:
                    high.append((n + 1) << 24)
                    done += 1
        self._skip(high, len(piece) - done)
        return [(h >> 24) - 1 for h in high[1:]]

    @staticmethod
    def _skip(high: list[int], n: int) -> None:
        """So many symbols are no tokens."""
        high += [0] * n

    def tokens(self, last: list[int]) -> list[int]:
        """The encoding of the whole piece, read from its stored last tokens."""
        out, end = [], len(last)
        while end:
            out.append(n := last[end - 1])
            end -= self.size[n] if n != NONE else 1
        return out[::-1]

    def edit(self, last: list[int], old: str, new: str) -> list[int]:
        """The table of new, keeping what old and new have in common at their beginning."""
        same = 0
        while same < min(len(old), len(new), len(last)) and old[same] == new[same]:
            same += 1
        return self.extend(last[:same], new)
