"""Small documents that several tests share."""

BASE = ("the quick brown fox jumps over the lazy dog while seven grey birds look on from a tall old tree near the "
        "river bank and count all of the small fish that swim by in the cold clear water of an early spring day "
        "before they fly home to rest and sing about what they saw in a long song with many verses")


def rows(texts, start=0, source="s", lang="en"):
    """Documents with columns of clashing names beside their own."""
    return [(start + i, t, lang, source, None if t is None else len(t), 7, "row", 3, "words") for i, t in enumerate(texts)]
