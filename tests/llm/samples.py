"""Made-up prose for tests."""

import random


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "and", "thing", "ering", "of", "on", "tion", "hand", "re", "wher", "anden", "onst"]) + rng.choice(["", "er", "ed", "ly", "es"]) for _ in range(n))
