"""Made-up texts for the tests."""

import random


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n))


def paragraphs(seed: int, n: int) -> str:
    return "\n".join(words(seed * 100 + i, 12).capitalize() + "." for i in range(n))
