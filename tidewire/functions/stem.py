"""The published English suffix-stripping algorithm (its second version) as column expressions.

Every step is one projection in SQL that Spark and DuckDB both read, so a query and its twin stem alike, and the work stays in generated code.
A word has two regions: R1 begins behind the first consonant after a vowel, R2 is the same within R1; most suffixes go only inside one of them.
A ``y`` at the start or behind a vowel counts as a consonant and is written ``Y`` on the way.  Words of two letters or fewer, and words with a digit, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

# The suffixes of each step with what stands in their place, and the words that go their own way.
STEP_2 = {
    "ational": "ate", "fulness": "ful", "iveness": "ive", "ization": "ize", "ousness": "ous", "biliti": "ble", "lessli": "less", "tional": "tion", "alism": "al", "aliti": "al", "ation": "ate", "entli": "ent",
    "fulli": "ful", "iviti": "ive", "ousli": "ous", "abli": "able", "alli": "al", "anci": "ance", "ator": "ate", "enci": "ence", "izer": "ize", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ["ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic"]
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_1A = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
OWN_R1 = ["gener", "commun", "arsen"]

REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _listed(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _mapped(of: str, pairs: dict[str, str]) -> str:
    return f"case {of} " + " ".join(f"when '{a}' then '{b}'" for a, b in pairs.items()) + " end"


def _has(text: str, pattern: str) -> str:
    return f"regexp_extract({text}, '{pattern}', 0) <> ''"


def _suffix(suffixes: list[str]) -> str:
    """The longest of the suffixes that the word ends with."""
    return f"regexp_extract(w, '({'|'.join(sorted(suffixes, key=len, reverse=True))})$', 0)"


def steps(word: str) -> list[dict[str, str]]:
    """The projections, one after another: name -> expression; what is not named stays."""
    marked = f"case when substr({word}, 1, 1) = 'y' then concat('Y', substr({word}, 2)) else {word} end"
    for v in "aeiouy":
        marked = f"replace({marked}, '{v}y', '{v}Y')"
    cut = "substr(w, 1, length(w) - length(s))"
    base = "substr(w, 1, length(w) - length(s))"
    return [
        {"w": marked},
        {"r1": " ".join(["case", *[f"when substr(w, 1, {len(p)}) = '{p}' then {len(p)}" for p in OWN_R1], f"when {_has('w', REGION)} then length(regexp_extract(w, '{REGION}', 0)) else length(w) end"])},
        {"r2": f"case when {_has('substr(w, r1 + 1)', REGION)} then r1 + length(regexp_extract(substr(w, r1 + 1), '{REGION}', 0)) else length(w) end"},
        # 1a: plurals
        {"s": _suffix(["sses", "ied", "ies", "us", "ss", "s"])},
        {"w": f"case when s = 'sses' then substr(w, 1, length(w) - 2) when s in ('ied', 'ies') then substr(w, 1, length(w) - case when length(w) > 4 then 2 else 1 end) when s = 's' and {_has('substr(w, 1, length(w) - 2)', '[aeiouy]')} then {cut} else w end"},
        {"s": f"case when w in ({_listed(AFTER_1A)}) then '' else {_suffix(['eedly', 'ingly', 'edly', 'eed', 'ing', 'ed'])} end", "done": f"w in ({_listed(AFTER_1A)})"},
        # 1b: past and progressive forms
        {"x": f"case when s in ('eed', 'eedly') then case when length({base}) >= r1 then concat({base}, 'ee') else w end when s <> '' and {_has(base, '[aeiouy]')} then {base} else w end", "free": f"s in ('ed', 'edly', 'ing', 'ingly') and {_has(base, '[aeiouy]')}"},
        {"w": f"case when not free then x when {_has('x', '(at|bl|iz)$')} then concat(x, 'e') when {_has('x', '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$')} then substr(x, 1, length(x) - 1) when r1 >= length(x) and {_has('x', SHORT)} then concat(x, 'e') else x end"},
        # 1c: a final y
        {"w": f"case when not done and {_has('w', '.[^aeiouy][yY]$')} then concat(substr(w, 1, length(w) - 1), 'i') else w end"},
        {"s": f"case when done then '' else {_suffix([*STEP_2])} end"},
        {"w": f"case when s = '' or length(w) - length(s) < r1 or (s = 'ogi' and {_has('w', '[^l]ogi$')}) or (s = 'li' and {_has('w', '[^cdeghkmnrt]li$')}) then w else concat({base}, {_mapped('s', STEP_2)}) end"},
        {"s": f"case when done then '' else {_suffix([*STEP_3])} end"},
        {"w": f"case when s = '' or length(w) - length(s) < case when s = 'ative' then r2 else r1 end then w else concat({base}, {_mapped('s', STEP_3)}) end"},
        {"s": f"case when done then '' else {_suffix(STEP_4)} end"},
        {"w": f"case when s = '' or length(w) - length(s) < r2 or (s = 'ion' and not {_has('w', '[st]ion$')}) then w else {base} end"},
        # 5: a final e, and one of two l
        {"s": "case when done then '' else substr(w, length(w)) end", "x": "substr(w, 1, length(w) - 1)"},
        {"w": f"case when s = 'e' and (length(x) >= r2 or (length(x) >= r1 and not {_has('x', SHORT)})) then x when s = 'l' and length(x) >= r2 and {_has('x', 'l$')} then x else w end"},
        {"w": f"case when length({word}) <= 2 or {_has(word, '[0-9]')} then {word} when {word} in ({_listed([*SPECIAL])}) then {_mapped(word, SPECIAL)} else replace(w, 'Y', 'y') end"},
    ]


NAMES = ["w", "r1", "r2", "s", "x", "done", "free"]


def stemmed(rows: DataFrame, word: str, into: str) -> DataFrame:
    """``rows`` with the stem of a lower-case word column.  Columns of the names that the steps use come back as they were."""
    held = {c: f"__held_{c}" for c in rows.columns if c in NAMES}
    inner, made = rows.withColumnsRenamed(held), []
    for step in steps(held.get(word, word)):
        made += [c for c in step if c not in made]
        keep = [c for c in inner.columns if c not in step]
        inner = inner.selectExpr(*[f"`{c}`" for c in keep], *[f"{e} as `{c}`" for c, e in step.items()])
    return inner.withColumnRenamed("w", "__stem").drop(*[c for c in made if c != "w"]).withColumnsRenamed({v: k for k, v in held.items()}).withColumnRenamed("__stem", into)


def stems_sql(source: str, word: str, name: str) -> str:
    """The same as common table expressions: the last one, ``name``, has the word and its ``stem``, each distinct word of ``source`` once."""
    out, before, columns = [f"{name}_0 as (select distinct {word} as word from {source})"], f"{name}_0", ["word"]
    for k, step in enumerate(steps("word"), 1):
        columns = [c for c in columns if c not in step]
        out.append(f"{name}_{k} as (select {', '.join([*columns, *[f'{e} as {c}' for c, e in step.items()]])} from {before})")
        columns, before = [*columns, *step], f"{name}_{k}"
    return ", ".join([*out, f"{name} as (select word, w as stem from {before})"])
