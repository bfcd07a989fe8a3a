"""Texts and schema of the tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "the of and stone river lantern quiet morning copper window garden paper silver tide branch hollow signal ember walnut drift meadow anchor velvet thunder".split()
MOTS = "le la et pierre rivière lanterne calme matin cuivre fenêtre jardin papier argent marée branche creux signal braise noyer dérive".split()


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randint(0, 999)) * (r.random() < 0.05) for _ in range(n))
