"""Training-data operators: each module holds one operator, its query and, where SQL can say it, its SQL."""


def load_all():
    """(queries, oracles) of the numbered operators."""
    from barwright.llm import (
        bpe, collocations, exact, language, lattice, license, mixing, prefixes, quality, simhash, substring, suffix, urls,
    )

    modules = (simhash, lattice, license, quality, substring, suffix, bpe, language, mixing, exact, urls, prefixes, collocations)
    return {m.NAME: m.query for m in modules}, {m.NAME: m.SQL for m in modules if m.SQL}
