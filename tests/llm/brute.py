"""Words and invented texts for brute-force versions."""

import random
import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, component string, band int, size string"


def words(text, lower=False):
    text = text or ""
    return WORDS.findall(text.translate(LOWER) if lower else text)


def prose(rng, n, vocabulary=300):
    out = []
    for i in range(n):
        word = "".join(rng.choice("etaoinsrhldu") for _ in range(1 + rng.randrange(vocabulary) % 9))
        out.append(word + ("\n" if rng.random() < 0.08 else " "))
    return "".join(out).strip()
