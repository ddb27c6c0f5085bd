"""DuckDB texts of the shared expressions, so that every oracle says the same as its plan."""

from __future__ import annotations

from .text import FOLDS, STOPWORDS, TOKEN


def fold(c: str) -> str:
    out = f"lower(replace(coalesce({c}, ''), 'İ', 'i' || chr(775)))"
    for a, b in FOLDS.items():
        out = f"replace({out}, '{a}', '{b}')"
    return out


STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens_all(c: str) -> str:
    return f"regexp_extract_all({fold(c)}, '{TOKEN}')"


def tokens(c: str) -> str:
    return f"list_filter({tokens_all(c)}, lambda t: not list_contains({STOP}, t))"


SPACE = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def clean_space(c: str) -> str:
    return f"trim(regexp_replace(coalesce({c}, ''), '{SPACE}', ' ', 'g'))"


def words(c: str) -> str:
    return f"list_filter(string_split({clean_space(c)}, ' '), lambda w: w <> '')"


def quality(title: str, content: str) -> str:
    n = f"cast(len({words(content)}) as double)"
    uniq = f"len(list_distinct(list_transform({words(content)}, lambda w: {fold('w')}))) / {n}"
    marks = f"length(regexp_replace(coalesce({content}, ''), '[^.,!?:;]', '', 'g')) / {n}"
    score = (
        f"0.45::double * least({n} / 250, 1) + 0.35::double * least(greatest(({uniq} - 0.18::double) / 0.45::double, 0), 1) + 0.20::double * least({marks} * 18, 1)"
        f" + case when {clean_space(title)} <> '' then 0.15::double else 0 end"
    )
    return f"case when {n} > 0 then round(least(greatest({score}, 0), 1), 4) else 0.0::double end"


def site(url: str) -> str:
    return rf"coalesce(lower(regexp_extract({url}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '')"
