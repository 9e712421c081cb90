"""Semi-Markov conditional random field over short regions of text.

A segmentation covers the tokens of a region by entities (whole spans of at
most LONGEST tokens, each with a type) and single outside tokens of score 0.
An entity scores the sum of the weights of its features, which may look at the
whole span; two entities side by side add the weight ``adjacent``.  One
dynamic programme over (position, was the last segment an entity) gives the
best segmentation, another one all marginals, linear in the candidates.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

LONGEST = 24            # tokens of an entity at most
ADJACENT = "adjacent"

Candidate = tuple[int, int, str, tuple[str, ...]]       # first token, token past the last, type, features
Gold = frozenset[tuple[int, int, str]]


def _log_sum(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


@dataclass
class SemiMarkov:
    weights: dict[str, float] = field(default_factory=dict)

    def score(self, features: Sequence[str]) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in features)

    def best(self, tokens: int, candidates: list[Candidate]) -> list[tuple[int, int, str]]:
        """The entities of the best segmentation, ascending; ties go to
        outside tokens, then to the candidate listed first."""
        ending = defaultdict(list)
        for c in candidates:
            ending[c[1]].append((c, self.score(c[3])))
        adjacent = self.weights.get(ADJACENT, 0.0)
        out, ent = [0.0] + [-math.inf] * tokens, [-math.inf] * (tokens + 1)
        back: list[tuple | None] = [None] * (tokens + 1)
        for i in range(1, tokens + 1):
            out[i] = max(out[i - 1], ent[i - 1])
            for (a, _, kind, _), s in ending[i]:
                after_entity = ent[a] + adjacent > out[a]
                total = max(out[a], ent[a] + adjacent) + s
                if total > ent[i]:
                    ent[i], back[i] = total, (a, kind, after_entity)
        found, i, entity = [], tokens, ent[tokens] > out[tokens]
        while i > 0:
            if entity:
                a, kind, entity = back[i]
                found.append((a, i, kind))
                i = a
            else:
                i -= 1
                entity = ent[i] > out[i]
        return found[::-1]

    def log_likelihood(self, tokens: int, candidates: list[Candidate], gold: Gold) -> tuple[float, dict[str, float]]:
        """Log-probability of ``gold`` and its gradient by feature."""
        adjacent = self.weights.get(ADJACENT, 0.0)
        scored = [(c, self.score(c[3])) for c in candidates]
        starting, ending = defaultdict(list), defaultdict(list)
        for c, s in scored:
            starting[c[0]].append((c, s))
            ending[c[1]].append((c, s))
        out, ent = [0.0] + [-math.inf] * tokens, [-math.inf] * (tokens + 1)
        for i in range(1, tokens + 1):
            out[i] = _log_sum(out[i - 1], ent[i - 1])
            for (a, _, _, _), s in ending[i]:
                ent[i] = _log_sum(ent[i], _log_sum(out[a], ent[a] + adjacent) + s)
        # cost from a position on, when the segment before it was outside / an entity
        past_out, past_ent = [0.0] * (tokens + 1), [0.0] * (tokens + 1)
        for i in range(tokens - 1, -1, -1):
            entity = -math.inf
            for (_, b, _, _), s in starting[i]:
                entity = _log_sum(entity, s + past_ent[b])
            past_out[i] = _log_sum(past_out[i + 1], entity)
            past_ent[i] = _log_sum(past_out[i + 1], entity + adjacent)
        whole = past_out[0]
        gradient: dict[str, float] = defaultdict(float)
        value, gold_ends = -whole, {b for _, b, _ in gold}
        for (a, b, kind, features), s in scored:
            right = (a, b, kind) in gold
            beside = math.exp(ent[a] + adjacent + s + past_ent[b] - whole)
            p = math.exp(out[a] + s + past_ent[b] - whole) + beside
            for f in features:
                gradient[f] += right - p
            touches = right and a in gold_ends
            gradient[ADJACENT] += touches - beside
            value += right * s + touches * adjacent
        return value, gradient


def train(examples: list[tuple[int, list[Candidate], Gold]], rounds: int = 12, rate: float = 0.5,
          penalty: float = 1e-3) -> SemiMarkov:
    """Maximum conditional likelihood by AdaGrad, in the order given."""
    model = SemiMarkov()
    squares: dict[str, float] = defaultdict(float)
    for _ in range(rounds):
        for tokens, candidates, gold in examples:
            _, gradient = model.log_likelihood(tokens, candidates, gold)
            for f, g in gradient.items():
                g -= penalty * model.weights.get(f, 0.0)
                squares[f] += g * g
                if squares[f] > 0:
                    model.weights[f] = model.weights.get(f, 0.0) + rate * g / math.sqrt(squares[f])
    return model


