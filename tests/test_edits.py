import random

from quarry.operators import metrics


def test_edits_are_those_of_the_table(spark):
    rng = random.Random(8)
    for _ in range(300):
        a, b = ("".join(rng.choices("abé\U0001f600", k=rng.randrange(90))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            former, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(former[j] + 1, row[-1] + 1, former[j - 1] + (x != y)))
        assert metrics.edits(a, b) == row[-1] == metrics.edits(list(a), list(b))
