"""Texts that the tests of this folder share."""

import re

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


PASSAGE = "The quick brown fox jumps over the lazy dog near the old river bank while seven tall men watch from the wooden bridge above it."
BODY = " ".join(f"word{i * i % 97}x{i}" for i in range(60))

#: doc_id, text: nulls, empties, blanks, exact and near copies, a long text, shared passages, odd characters.
TEXTS = [
    (0, PASSAGE + " first tail"),
    (1, "another start " + PASSAGE),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, BODY),
    (6, BODY),
    (7, BODY.replace("word0x0 ", "changed ")),
    (8, "a b"),
    (9, "A  B"),
    (10, "ab" * 300),
    (20, "Ünïcödé 日本語 " + PASSAGE.upper()),
    (21, PASSAGE + PASSAGE),
    (40, "line one is here and it is long enough to count as a line\nline two\nline one is here and it is long enough to count as a line"),
    (41, "line one is here and it is long enough to count as a lime\nline two\nline tree\n\nend   x"),
    (60, " ".join(["lorem", "ipsum", "dolor"] * 700)),
]
