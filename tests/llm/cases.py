"""Hard documents for all operators, and plain Python versions of what they compute."""

from __future__ import annotations

import random
import re
import zlib

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, place bigint, start string, "
    "sequence_id string, shard string, curve string, token string, n string, cls string, chunk string, "
    "lang_pred string, score string, size string, block string, prefix string, head string, _place string, learned string"
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: str | None, rule: re.Pattern = SPACED) -> list[str]:
    return rule.findall((text or "").translate(LOWER))


def sentence(rng: random.Random, size: int, vocabulary: int = 5000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(size))


def hard_texts() -> list[tuple[int | None, str | None]]:
    """(doc_id, text) with nulls, empties, repeats, ties and one very long text."""
    rng = random.Random(5)
    base = sentence(rng, 130)
    rows: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "two words"), (7, "TWO\nwords"),
        (8, "Ünï cödé — çà, ÉTÉ 日本語 text"), (9, "a\x00b \x0b\x0c\x85 <|endoftext|> it's"), (None, base), (None, None),
        (10, base), (10, base), (11, base.upper()), (12, sentence(rng, 60_000, 200_000)), (13, "!!! 123 ??"),
    ]
    for doc_id in range(20, 60):  # near copies, by one to five changed words
        own = base.split()
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(9999)}"
        rows.append((doc_id, " ".join(own)))
    rows += [(doc_id, base) for doc_id in range(100, 160)]  # a third of all rows are copies
    return rows


def stored(spark, folder, rows, lang=None):
    """The rows as a stored table whose other columns have names that operators use themselves."""
    full = [(i, t, lang(i) if lang else None, "s", None, None, *["clash"] * 16) for i, t in rows]
    path = str(folder / "docs.parquet")
    spark.createDataFrame(full, SCHEMA).repartition(3).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def shingles(text: str | None, size: int) -> frozenset:
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def components(rows, size: int = 3, num: int = 90, den: int = 100) -> list[tuple]:
    """(doc_id, number of shingles, component) of every row, by comparing all pairs."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and den * common >= num * (len(x) + len(sets[j]) - common):
                root[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def in_order(rows):
    return sorted(map(tuple, rows), key=repr)
