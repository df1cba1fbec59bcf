"""Made-up texts for the tests."""


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "the", "or", "ti", "re", "é", "st", "ing"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)
