import random

import pytest

WORDS = "river mill town sea farm road hill stone bridge field light water boat rope wheel grain oak elm ash fox".split()


@pytest.fixture
def words():
    """A text of n pseudo-random words."""

    def make(n, seed=0, vocabulary=4000):
        rng = random.Random(seed)
        return " ".join(f"{rng.choice(WORDS)}{rng.randrange(vocabulary)}" for _ in range(n))

    return make
