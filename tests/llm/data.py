"""Small tables for the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LETTERS = {"en": "the of and thing water under", "fr": "été où leçon rêve garçon très", "de": "für über straße schön gemüse äpfel"}


def word(rng, lang):
    return "".join(rng.choice(LETTERS[lang].split())[:rng.randint(2, 5)] for _ in range(rng.randint(1, 3)))


def corpus(n=240, seed=5):
    """Documents with exact and near copies, shared passages and short texts."""
    rng = random.Random(seed)
    passages = [[word(rng, "en") for _ in range(rng.randint(12, 70))] for _ in range(6)]
    rows = []
    for i in range(n):
        lang = rng.choice(list(LETTERS))
        if rows and rng.random() < 0.15:
            text = rng.choice(rows)[1]
        elif rows and rng.random() < 0.2:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(max(1, len(words) // 40)):
                words[rng.randrange(len(words))] = word(rng, lang)
            text = " ".join(words)
        else:
            words = [word(rng, lang) for _ in range(rng.randint(1, 150))]
            if rng.random() < 0.3:
                at = rng.randint(0, len(words))
                words[at:at] = rng.choice(passages)
            text = rng.choice([" ", " ", "\n"]).join(words)
        rows.append((i, text, lang, f"src{rng.randint(0, 3)}", len(text)))
    return rows


# null and blank texts, nulls in every column, a repeated row, one very long text, one very long word, odd characters
EDGES = [
    (1, None, "en", "a", 0), (2, "", "en", None, None), (3, " \t\n ", None, "a", 3), (4, "one two", "en", "a", 7),
    (None, "a text without an id, long enough to have some shingles in it", None, None, None),
    (5, "same words again and again " * 4000, "en", "a", 108000), (6, "x" * 40000, "fr", "b", 40000),
    (7, "12345 67890 ### $$$", "de", "b", 19), (8, "same row twice, with quite a few words in it to see", "en", "a", 50),
    (8, "same row twice, with quite a few words in it to see", "en", "a", 50), (9, "ß é\x85 \x1c\x1f É́ İ <|endoftext|> \U0001f600", "fr", "b", 20),
    (10, "same row twice, with quite a few words in it to see", "en", "a", 50),
]
# names that the operators use themselves
CLASHES = ("block", "class", "words", "held_out", "anchor", "anchor_at", "bucket", "topic", "score", "kept", "word", "n", "live", "hits",
           "doc_key", "shard", "id", "probability", "grams", "label", "has_letter", "bands")
