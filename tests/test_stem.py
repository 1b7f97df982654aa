"""The stemmer against a plain procedure, and published pairs."""

import random
import re

import duckdb

from tidewire.functions import stem

# Pairs from the published sample vocabulary and the rules' own examples.
PAIRS = {
    "consign": "consign", "consigned": "consign", "consigning": "consign", "consignment": "consign", "consist": "consist", "consisted": "consist", "consistency": "consist", "consistent": "consist", "consistently": "consist",
    "consisting": "consist", "consists": "consist", "consolation": "consol", "consolations": "consol", "consolatory": "consolatori", "console": "consol", "consoled": "consol", "consolingly": "consol",
    "knack": "knack", "knackeries": "knackeri", "knavish": "knavish", "kneaded": "knead", "kneel": "kneel", "knees": "knee", "knell": "knell", "knelt": "knelt", "knightly": "knight", "knitting": "knit", "knives": "knive", "knocker": "knocker",
    "knotted": "knot", "knotty": "knotti", "knowing": "know", "ties": "tie", "cries": "cri", "gas": "gas", "this": "this", "gaps": "gap", "kiwis": "kiwi", "luxuriating": "luxuri", "hopping": "hop", "hoping": "hope", "cry": "cri", "by": "by", "say": "say",
    "generate": "generat", "generously": "generous", "communism": "communism", "dying": "die", "news": "news", "proceed": "proceed", "exceed": "exceed", "succeeding": "succeed", "sky": "sky", "skies": "sky", "inning": "inning", "innings": "inning",
    "relational": "relat", "conditional": "condit", "rationalization": "ration", "hopefulness": "hope", "sensibility": "sensibl", "archaeology": "archaeolog", "formative": "format", "adoption": "adopt", "controlling": "control", "yearly": "year", "youth": "youth",
}


def plain(word):
    """The algorithm step by step, on one word."""
    if len(word) <= 2 or re.search("[0-9]", word):
        return word
    if word in stem.SPECIAL:
        return stem.SPECIAL[word]
    w = list(word)
    for i, c in enumerate(w):
        if c == "y" and (i == 0 or w[i - 1] in "aeiouy"):
            w[i] = "Y"
    w = "".join(w)
    vowel = lambda c: c in "aeiouy"

    def behind(start):
        for i in range(start, len(w) - 1):
            if vowel(w[i]) and not vowel(w[i + 1]):
                return i + 2
        return len(w)

    r1 = next((len(p) for p in stem.OWN_R1 if w.startswith(p)), None) or behind(0)
    r2 = behind(r1)

    def short(x):
        if len(x) == 2:
            return vowel(x[0]) and not vowel(x[1])
        return len(x) > 2 and not vowel(x[-3]) and vowel(x[-2]) and not vowel(x[-1]) and x[-1] not in "wxY"

    longest = lambda options: max((s for s in options if w.endswith(s)), key=len, default="")
    s = longest(["sses", "ied", "ies", "us", "ss", "s"])
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif s == "s" and any(map(vowel, w[:-2])):
        w = w[:-1]
    if w in stem.AFTER_1A:
        return w
    s = longest(["eed", "eedly", "ed", "edly", "ing", "ingly"])
    if s.startswith("eed"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(map(vowel, w[: -len(s)])):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w[-2:] in ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt"):
            w = w[:-1]
        elif r1 >= len(w) and short(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and not vowel(w[-2]):
        w = w[:-1] + "i"
    s = longest(stem.STEP_2)
    if s and len(w) - len(s) >= r1 and (s != "ogi" or w.endswith("logi")) and (s != "li" or w[-3] in "cdeghkmnrt"):
        w = w[: -len(s)] + stem.STEP_2[s]
    s = longest(stem.STEP_3)
    if s and len(w) - len(s) >= (r2 if s == "ative" else r1):
        w = w[: -len(s)] + stem.STEP_3[s]
    s = longest(stem.STEP_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not short(w[:-1]))):
        w = w[:-1]
    elif w.endswith("l") and len(w) - 1 >= r2 and w[-2:-1] == "l":
        w = w[:-1]
    return w.replace("Y", "y")


def words():
    rng = random.Random(3)
    suffixes = [*stem.STEP_2, *stem.STEP_3, *stem.STEP_4, "s", "es", "ies", "ied", "ed", "ing", "edly", "ingly", "eed", "eedly", "sses", "us", "ss", "y", "e", "ll", "ly", "logi", ""]
    made = {"".join(rng.choices("aeioubcdglmnprstyvwxz", k=rng.randint(1, 6))) + rng.choice(suffixes) + rng.choice(["", "", rng.choice(suffixes)]) for _ in range(6000)}
    return sorted(made | set(PAIRS) | set(stem.SPECIAL) | set(stem.AFTER_1A) | {"", "a1", "covid19", "größe", "yy", "sayyid", "communal", "arsenal", "generic"})


def test_published_pairs():
    assert {w: plain(w) for w in PAIRS} == PAIRS


def test_columns_equal_the_plain_procedure(spark):
    frame = spark.createDataFrame([(i, w, "kept") for i, w in enumerate(words())], "id long, word string, s string")
    got = stem.stemmed(frame, "word", "stem")
    assert got.columns == ["id", "word", "s", "stem"] or set(got.columns) == {"id", "word", "s", "stem"}
    rows = got.collect()
    assert not [(r.word, r.stem, plain(r.word)) for r in rows if r.stem != plain(r.word)] and all(r.s == "kept" for r in rows)


def test_the_twin_stems_alike():
    con = duckdb.connect()
    con.execute("create table vocabulary as select unnest(?) as term", [words()])
    got = dict(con.execute(f"with {stem.stems_sql('vocabulary', 'term', 'stems')} select word, stem from stems").fetchall())
    assert got == {w: plain(w) for w in words()}
