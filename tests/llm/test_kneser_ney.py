import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from leadwright.llm.language_id import ORDER, Identifier, Model, keys_of


class Brute:
    """Interpolated Kneser-Ney over strings, by dictionaries and recursion."""

    def __init__(self, grams):
        self.counts = {ORDER: Counter(grams)}
        for n in range(ORDER - 1, 0, -1):
            before = defaultdict(set)
            for gram in self.counts[n + 1]:
                before[gram[1:]].add(gram[0])
            self.counts[n] = Counter({g: len(b) for g, b in before.items()})
        self.uniform = 1 / (len(self.counts[1]) + 1)

    def discount(self, n):
        ones, twos = (sum(c == k for c in self.counts[n].values()) for k in (1, 2))
        return ones / (ones + 2 * twos) if ones and twos else 0.5

    def chance(self, gram):
        if not gram:
            return self.uniform
        n, d = len(gram), self.discount(len(gram))
        same = {g: c for g, c in self.counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return self.chance(gram[1:])
        return (max(same.get(gram, 0) - d, 0) + d * len(same) * self.chance(gram[1:])) / sum(same.values())


def spell(key):
    return "".join(chr(int(key) >> 16 * (ORDER - 1 - i) & 0xFFFF) for i in range(ORDER))


@pytest.mark.parametrize("seed", range(3))
def test_probabilities_are_those_of_dictionaries(seed):
    r = random.Random(seed)
    texts = ["".join(r.choice("aabcd ") for _ in range(r.randrange(2, 60))) for _ in range(8)]
    keys = keys_of(texts, Identifier({}).letters)[0]
    model, brute = Model(*np.unique(keys, return_counts=True)), Brute([spell(k) for k in keys])
    probe = keys_of(["".join(r.choice("abcdex ") for _ in range(200))], Identifier({}).letters)[0]
    assert model.probability(probe) == pytest.approx([brute.chance(spell(k)) for k in probe])


def test_entropy_is_the_mean_of_the_logarithms():
    keys = keys_of(["abra cadabra", "barbara"], Identifier({}).letters)[0]
    model = Identifier({"x": np.unique(keys, return_counts=True)})
    brute = Brute([spell(k) for k in keys])
    bits, n, letters = model.entropies(["cab rad", "zz"])
    for text, got, size in zip(["cab rad", "zz"], bits[:, 0], n):
        grams = [spell(k) for k in keys_of([text], model.letters)[0]]
        assert size == len(grams) and got == pytest.approx(-sum(np.log2(brute.chance(g)) for g in grams) / len(grams))
