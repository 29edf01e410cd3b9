"""Merging symbol pairs in many pieces at once."""

from __future__ import annotations

import numpy as np


class Pairs:
    """Merge rules: (left, right) -> merged symbol, where a smaller merged symbol goes first."""

    def __init__(self, rules: dict[int, int], size: int):
        """`rules` maps left * size + right to the merged symbol; all symbols are below `size`."""
        self.size = size
        self.keys = np.array(sorted(rules), np.int64)
        self.merged = np.array([rules[k] for k in self.keys.tolist()], np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged symbol of each pair; `size` where there is no rule."""
        wanted = left * self.size + right
        place = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[place] == wanted, self.merged[place], self.size)

    def merge(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged symbols of consecutive pieces, and their number per piece.

        In each step every piece merges the leftmost of its best pairs; pieces without one
        are set aside. Only the pairs beside a merge are looked up anew.
        """
        done_ids, done_owner = [], []
        owner = np.repeat(np.arange(len(lengths)), lengths)
        ids = ids.astype(np.int64)
        ranks = np.full(len(ids), self.size, np.int64)  # of each symbol with the next one
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        ranks[inside] = self.ranks(ids[inside], ids[inside + 1])
        while len(ids):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(ranks, first)
            sizes = np.diff(np.append(first, len(ids)))
            open_rows = np.repeat(best < self.size, sizes)
            done_ids.append(ids[~open_rows])
            done_owner.append(owner[~open_rows])
            hits = np.flatnonzero(open_rows & (ranks == np.repeat(best, sizes)))
            if not len(hits):
                break
            hits = hits[np.append(True, owner[hits][1:] != owner[hits][:-1])]
            ids[hits] = ranks[hits]
            changed = np.zeros(len(ids), bool)
            changed[hits] = True
            open_rows[hits + 1] = False
            ids, owner, ranks, changed = ids[open_rows], owner[open_rows], ranks[open_rows], changed[open_rows]
            changed[:-1] |= changed[1:].copy()  # and the symbol before each
            at = np.flatnonzero(changed)
            ranks[at] = self.size
            at = at[at + 1 < len(ids)]
            at = at[owner[at] == owner[at + 1]]
            ranks[at] = self.ranks(ids[at], ids[at + 1])
        owner = np.concatenate(done_owner) if done_owner else owner
        ids = np.concatenate(done_ids) if done_ids else ids
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))
