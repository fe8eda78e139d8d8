"""PII: format-preserving Feistel pseudonyms.

DataFrame functions only. Validated numbers (payment cards, IBANs, phone and
social security numbers, IPv4 addresses) and dates are permuted by a keyed
Feistel network among the valid values of their format, so a value has the same
pseudonym wherever it stands and no two values share one (an octet's leading
zeros are spelling, not value). E-mail addresses and secrets have no number to
permute; a keyed digest of theirs stands in their place. All patterns take time
in proportion to the text: nothing but single characters and possessive groups
repeats without a bound.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrado.llm.common import free_name

#: Rounds of the network.
ROUNDS = 8
#: Dates from 1900-01-01 on that are permuted among themselves: 271 * 271 of them.
DATE_SIDE = 271
#: Steps of a date's walk to the next one of its class; a class has over a third of the dates, so the odds that any walk is longer are 1e-14.
WALK = 96
#: Areas (1 to 899, not 666), groups and serials of a social security number.
AREAS, GROUPS, SERIALS = 898, 99, 9999

#: IBAN lengths by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FK|FO|GL|NL|SD", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|MN|XK", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|IL|IQ|OM|SO|TL", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST", 26: "IS|TR",
    27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HN|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE", 31: "MT|SC", 32: "LC", 33: "RU",
}


def _iban_of(length: int, countries: str) -> str:
    fours, rest = divmod(length - 4, 4)
    return f"(?:{countries})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{fours}}}" + (f" ?[A-Z0-9]{{{rest}}}" if rest else "")


# The patterns, by kind; the first that fits at a place counts (a domain has 127 labels at most). A card's is the whole run of digit groups it may be in.
PATTERNS = {
    "email": r"(?:(?<![\p{L}\p{M}\p{N}._%+-])|\G(?<=[^\p{L}\p{M}\p{N}._%+-][\p{L}\p{M}\p{N}._%+-]{0,100}))[\p{L}\p{M}\p{N}._%+-]++@(?:(?:[\p{L}\p{M}\p{N}-]++\.(?=[\p{L}\p{M}\p{N}-]))++\p{L}{2,}|(?:[\p{L}\p{M}\p{N}-]++\.){1,127}\p{L}{2,})",
    "secret": r"\bAKIA[0-9A-Z]{16}\b|\b(?i:password|passwd|secret|token|api[_-]?key)\s*+[=:]\s*+[\"']?[A-Za-z0-9+/_-]{8,}[\"']?",
    "iban": r"\b(?:" + "|".join(_iban_of(n, c) for n, c in IBAN_LENGTHS.items()) + r")\b",
    "other_iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "date": r"\b(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})(?![0-9])",
    "ip": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}\b|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}\b|\b[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}\b",
    "card": r"\b(?=[0-9](?:[ -]?[0-9]){12})[0-9]++\b(?:[ -][0-9]++\b)*+",
}
#: Patterns that may take more than their value and be invalid for it: what they leave is read again without them, one after the other.
AGAIN = ("other_iban", "iban", "card")
#: Spark's settings by which its parser drops the states that it has cached, once they are so many.
PARSER = {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "500"}


def _let(value: str, name: str, body: str) -> str:
    """SQL: body, with name for value, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _number(key: str, *inputs: str) -> str:
    """SQL: a keyed number of 60 bits."""
    return f"cast(conv(substr(sha2(concat_ws('|', '{key}', {', '.join(inputs)}), 256), 1, 15), 16, 10) as bigint)"


def feistel(left: str, right: str, size_left: str, size_right: str, key: str, tweak: str) -> str:
    """SQL: struct l, r, a permutation of the pairs below the two sizes (bigints), by alternating rounds."""
    f = lambda of, size: f"pmod({_number(key, tweak, 'k', of)}, {size})"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, k) -> if(k % 2 = 1,"
        f" named_struct('l', (s.l + {f('s.r', size_left)}) % {size_left}, 'r', s.r),"
        f" named_struct('l', s.l, 'r', (s.r + {f('s.l', size_right)}) % {size_right})))"
    )


def permuted_digits(digits: str, key: str, tweak: str) -> str:
    """SQL: a string of 2 to 36 digits permuted among those of its length."""
    half, rest = "cast(length(d) div 2 as int)", "cast(length(d) - length(d) div 2 as int)"
    power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
    mixed = feistel(f"substr(d, 1, {half})", f"substr(d, {half} + 1)", power(half), power(rest), key, f"'{tweak}', length(d)")
    return _let(digits, "d", _let(mixed, "p", f"concat(lpad(cast(p.l as string), {half}, '0'), lpad(cast(p.r as string), {rest}, '0'))"))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, digits: str) -> str:
    """SQL: m with its digits replaced in turn."""
    return _let(
        digits,
        "nd",
        f"aggregate(sequence(1, length({m})), named_struct('o', '', 'k', 1), (s, i) -> if(substr({m}, i, 1) between '0' and '9',"
        f" named_struct('o', concat(s.o, substr(nd, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, substr({m}, i, 1)), 'k', s.k)), s -> s.o)",
    )


def luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a string of digits."""
    x = f"cast(substr({digits}, length({digits}) - i + 1, 1) as int)"
    return f"aggregate(sequence(1, length({digits})), 0, (t, i) -> t + if(i % 2 = 1, {x}, if({x} > 4, 2 * {x} - 9, 2 * {x})))"


def mod97(iban: str) -> str:
    """SQL: the remainder that is 1 for a valid IBAN without spaces."""
    turned = f"concat(substr({iban}, 5), substr({iban}, 1, 4))"
    c = "substr(u, i, 1)"
    step = f"if({c} between '0' and '9', (t * 10 + cast({c} as int)) % 97, (t * 100 + ascii({c}) - 55) % 97)"
    return _let(turned, "u", f"aggregate(sequence(1, length(u)), 0, (t, i) -> cast({step.replace(f'cast({c} as int)', f'coalesce(try_cast({c} as int), 0)')} as int))")


def _card(m: str, key: str) -> str:
    payload = permuted_digits("substr(c, 1, length(c) - 1)", key, "card")
    # all zeros is no card, so what would become that takes the place that zeros would have
    payload = _let(payload, "once", f"if(once rlike '^0+$', {permuted_digits('once', key, 'card')}, once)")
    check = f"cast((10 - {luhn_sum('z')} % 10) % 10 as string)"
    done = _let(payload, "q", f"concat(q, {_let('concat(q, ' + chr(39) + '0' + chr(39) + ')', 'z', check)})")
    return _let(_digits(m), "c", _refill(m, done))


def _cards(m: str, key: str) -> str:
    """SQL: the items of a run of digit groups: its cards, which begin and end with a group, and what is between.

    A group's Luhn sums are made once; from each group at most 19 further ones are added up to see where a card ends.

    A card is 13 to 19 digits that pass Luhn. From each group the usual lengths and first digits
    win, then the longer; from left to right, one that is not usual gives way to a usual one that begins in it.
    """
    x = "cast(substr(d, i, 1) as int)"
    # the Luhn sums of a group's digits, its last one plain (a) or doubled (b); a longer group is in no card
    sums = f"aggregate(sequence(1, length(d)), named_struct('a', 0, 'b', 0), (t, i) -> named_struct('a', t.b + {x}, 'b', t.a + if({x} > 4, 2 * {x} - 9, 2 * {x})))"
    summed = _let(sums, "u", "named_struct('n', length(d), 'a', u.a, 'b', u.b, 'd', d)")
    fact = _let("trim(TRAILING ' -' FROM g)", "d", f"if(length(d) > 19, named_struct('n', 99, 'a', 0, 'b', 0, 'd', ''), {summed})")
    facts = f"transform(gs, g -> {fact})"
    # a group behind others: an even number of digits leaves what is before it as it was, an odd one turns plain and doubled
    c, a, b = "(t.c + f.n)", "(if(f.n % 2 = 0, t.a, t.b) + f.a)", "(if(f.n % 2 = 0, t.b, t.a) + f.b)"
    usual = f"if(({c} = 16 and h between '20' and '69') or ({c} = 15 and h in ('34', '37')), 100, 0)"
    weight = f"if({c} >= 13 and {a} % 10 = 0 and {a} + {b} > 0, {c} + {usual}, 0)"
    step = f"named_struct('c', {c}, 'a', {a}, 'b', {b}, 'k', t.k + 1, 'w', greatest(t.w, {weight}), 'best', if({weight} > t.w, t.k + 1, t.best))"
    tried = f"aggregate(slice(fs, j, 19), named_struct('c', 0, 'a', 0, 'b', 0, 'k', 0, 'w', 0, 'best', 0), (t, f) -> if({c} > 19, named_struct('c', 99, 'a', 0, 'b', 0, 'k', 0, 'w', t.w, 'best', t.best), {step}))"
    one = "if(r.w = 0, cast(null as struct<w:int,c:int,v:string>), named_struct('w', r.w, 'c', r.best, 'v', trim(TRAILING ' -' FROM array_join(slice(gs, j, r.best), ''))))"
    first_two = "substr(concat(fs[j - 1].d, if(j < size(fs), fs[j].d, '')), 1, 2)"
    best = f"transform(sequence(1, size(gs)), j -> {_let(first_two, 'h', _let(tried, 'r', one))})"
    yields = "best[j - 1].w < 100 and exists(slice(best, j + 1, best[j - 1].c - 1), x -> x.w >= 100)"
    taken = "named_struct('p', j + best[j - 1].c, 'o', concat(t.o, array(named_struct('s', j, 'e', j + best[j - 1].c, 'v', best[j - 1].v))))"
    none = "named_struct('p', 1, 'o', cast(array() as array<struct<s:int,e:int,v:string>>))"
    chosen = f"aggregate(sequence(1, size(gs)), {none}, (t, j) -> if(j < t.p or best[j - 1] is null or {yields}, t, {taken}), t -> t.o)"
    # what parts the last group of a card from the next group comes after the card
    after = "if(k = 0, '', regexp_extract(gs[cs[k - 1].e - 2], '[ -]$', 0))"
    plain = lambda e: f"named_struct('t', concat({after}, array_join(slice(gs, if(k = 0, 1, cs[k - 1].e), {e} - if(k = 0, 1, cs[k - 1].e)), '')), 'k', '')"
    card = f"named_struct('t', {_let('cs[k].v', 'one', _card('one', key))}, 'k', 'card')"
    pieces = f"flatten(transform(sequence(0, size(cs)), k -> if(k = size(cs), array({plain('size(gs) + 1')}), array({plain('cs[k].s')}, {card}))))"
    whole = f"if(size(cs) = 0, array(named_struct('t', {m}, 'k', '')), {pieces})"
    return _let(f"regexp_extract_all({m}, '[0-9]++[ -]?', 0)", "gs", _let(facts, "fs", _let(best, "best", _let(chosen, "cs", whole))))


def _iban(m: str, key: str) -> str:
    inner = permuted_digits(_digits("substr(b, 5)"), key, "iban")
    body = _let(_refill("substr(b, 5)", inner), "n", _let("concat(substr(b, 1, 2), '00', n)", "o", f"concat(substr(b, 1, 2), lpad(cast(98 - {mod97('o')} as string), 2, '0'), n)"))
    spaced = f"aggregate(sequence(1, length({m})), named_struct('o', '', 'k', 1), (s, i) -> if(substr({m}, i, 1) = ' ', named_struct('o', concat(s.o, ' '), 'k', s.k), named_struct('o', concat(s.o, substr(nb, s.k, 1)), 'k', s.k + 1)), s -> s.o)"
    valid = f"length(b) between 15 and 34 and substr(b, 3, 2) between '02' and '98' and length({_digits('substr(b, 5)')}) between 2 and 30 and {mod97('b')} = 1"
    return _let(f"replace({m}, ' ', '')", "b", f"if({valid}, {_let(body, 'nb', spaced)}, {m})")


def _phone(m: str, key: str) -> str:
    # the first digit stays (a country code of one digit or the beginning of one)
    moved = f"concat(substr(c, 1, 1), {permuted_digits('substr(c, 2)', key, 'phone')})"
    return _let(_digits(m), "c", f"if(length(c) between 8 and 15, {_refill(m, moved)}, {m})")


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"cast(substr({m}, {at}) as bigint)" for at in ("1, 3", "5, 2", "8"))
    valid = f"substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) <> '9' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000'"
    mixed = feistel(f"({area} - if({area} > 666, 2, 1)) * {GROUPS} + {group} - 1", f"{serial} - 1", str(AREAS * GROUPS), str(SERIALS), key, "'ssn'")
    shown = f"concat(lpad(cast(p.l div {GROUPS} + if(p.l div {GROUPS} >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(p.l % {GROUPS} + 1 as string), 2, '0'), '-', lpad(cast(p.r + 1 as string), 4, '0'))"
    return f"if({valid}, {_let(mixed, 'p', shown)}, {m})"


def _ip(m: str, key: str) -> str:
    octets = [f"cast(x[{i}] as bigint)" for i in range(4)]
    mixed = feistel(f"{octets[0]} * 256 + {octets[1]}", f"{octets[2]} * 256 + {octets[3]}", "65536", "65536", key, "'ip'")
    shown = "concat_ws('.', cast(p.l div 256 as string), cast(p.l % 256 as string), cast(p.r div 256 as string), cast(p.r % 256 as string))"
    valid = " and ".join(f"{o} <= 255" for o in octets)
    return _let(rf"split({m}, '[.]')", "x", f"if({valid}, {_let(mixed, 'p', shown)}, {m})")


def _date(m: str, key: str) -> str:
    """Dates with a day to 12 and those with a later one are permuted apart, so 03/14/2001 never becomes what could be read day first."""
    first = "date'1900-01-01'"
    n = DATE_SIDE * DATE_SIDE
    late = lambda d: f"(day(date_add({first}, cast({d} as int))) > 12)"
    mixed = feistel(f"s.d div {DATE_SIDE}", f"s.d % {DATE_SIDE}", str(DATE_SIDE), str(DATE_SIDE), key, "'date'")
    step = _let(_let(mixed, "p", f"p.l * {DATE_SIDE} + p.r"), "nx", f"named_struct('d', nx, 'k', {late('nx')} = {late('dd')})")
    # the walk ends at the next date of the same class; the lambda of feistel() names its own state s and k
    walked = f"aggregate(sequence(1, {WALK}), named_struct('d', cast(dd as bigint), 'k', false), (w, i) -> if(w.k, w, {_let('w', 's', step)}), w -> w.d)"
    layouts = [("substr({m}, 5, 1) = '-'", "yyyy-MM-dd")] + [(f"substr({{m}}, 3, 1) = '{sep}'", layout) for sep in "/." for layout in (f"dd{sep}MM{sep}yyyy", f"MM{sep}dd{sep}yyyy")]
    # the layout is found first, so that the walk stands in the plan once
    layout = "CASE" + "".join(f" WHEN {test.format(m=m)} AND try_to_timestamp({m}, '{x}') IS NOT NULL THEN '{x}'" for test, x in layouts) + " END"
    day = f"datediff(to_date(try_to_timestamp({m}, f)), {first})"
    shown = f"date_format(date_add({first}, cast({walked} as int)), f)"
    return _let(layout, "f", f"if(f is null, {m}, {_let(day, 'dd', f'if(dd >= 0 and dd < {n}, {shown}, {m})')})")


def _email(m: str, key: str) -> str:
    return f"concat('u', substr(sha2(concat_ws('|', '{key}', 'email', lower({m})), 256), 1, 20), '@pseudonym.invalid')"


def _secret(m: str, key: str) -> str:
    return f"concat('secret-', substr(sha2(concat_ws('|', '{key}', 'secret', {m}), 256), 1, 20))"


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "other_iban": _iban, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone}


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _kinds(step: int) -> list[str]:
    """The kinds that a step reads; step 0 reads all."""
    return [kind for kind in PATTERNS if kind not in AGAIN[:step]]


def pseudonym(m: str, key: str, step: str) -> str:
    """SQL: what stands for the match m of a step (SQL, too): items t, k (the kind; empty if t is left as it is)."""
    cases = ""
    for kind in PATTERNS:
        made = _cards(m, key) if kind == "card" else _let(_MAKERS[kind](m, key), "w", f"array(named_struct('t', w, 'k', if(w = {m}, '', '{kind.removeprefix('other_')}')))")
        read = f"{step} <= {AGAIN.index(kind)} and " if kind in AGAIN else ""
        cases += f" WHEN {read}{m} rlike {_sql(f'^(?:{PATTERNS[kind]})$')} THEN {made}"
    return f"CASE{cases} ELSE array(named_struct('t', {m}, 'k', '')) END"


def _scan(t: str, key: str, step: str) -> str:
    """SQL: the items of a text, in order; those between the matches have a null kind."""

    def by_step(call: str) -> str:
        """The pattern is each step's own, as a literal, so that it is compiled once."""
        any_ = [_sql("|".join(f"(?:{PATTERNS[kind]})" for kind in _kinds(k))) for k in range(len(AGAIN) + 1)]
        return f"CASE {step}" + "".join(f" WHEN {k} THEN {call.format(x)}" for k, x in enumerate(any_[:-1])) + f" ELSE {call.format(any_[-1])} END"

    made = f"transform({by_step(f'regexp_extract_all({t}, {{}}, 0)')}, m -> {pseudonym('m', key, step)})"
    plain = "array(named_struct('t', a, 'k', cast(null as string)))"
    return f"if({t} rlike '[0-9@=:]' and {by_step(f'{t} rlike {{}}')}, flatten(zip_with({by_step(f'split({t}, {{}}, -1)')}, {made}, (a, b) -> concat({plain}, coalesce(b, cast(array() as array<struct<t:string,k:string>>))))), {plain.replace("'t', a", f"'t', {t}")})"


def _merged(items: str, key: str) -> str:
    """SQL: items with all that is left between two values as one. A part of the key's digest, which no text holds, stands for a value meanwhile."""
    mark = f"'<{key[:24]}>'"
    text = f"array_join(transform({items}, it -> if(it.k <> '', {mark}, it.t)), '')"
    plain = "array(named_struct('t', a, 'k', cast(null as string)))"
    return f"flatten(zip_with(split({text}, {mark}, -1), filter({items}, it -> it.k <> ''), (a, b) -> if(b is null, {plain}, concat({plain}, array(b)))))"


@contextmanager
def _parsed_lightly(spark: SparkSession) -> Iterator[None]:
    """The parser lets its cache go meanwhile: what it keeps of such long expressions is 40 MB of the driver's memory for good."""
    before = {name: spark.conf.get(name, None) for name in PARSER}
    try:
        for name, value in PARSER.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def pseudonymised(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, str]:
    """docs and a struct column besides, with its name: text, found (kinds of the values replaced, in order). A null text stays null.

    The plan holds a digest of the key, from which the pseudonyms can be made as well as from the key: keep event logs as safe as the key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    key = hashlib.sha256(key.encode()).hexdigest()
    name = free_name(docs, "pii")
    # all steps are one lambda over their numbers, so that what makes the pseudonyms stands in the plan once: it is most of the driver's memory
    found = f"flatten(transform(if(step = 0, done, {_merged('done', key)}), it -> if(it.k is null, {_scan('it.t', key, 'step')}, array(it))))"
    steps = f"aggregate(sequence(0, {len(AGAIN)}), array(named_struct('t', {text}, 'k', cast(null as string))), (done, step) -> if(step = 0 or exists(done, it -> it.k = ''), {found}, done))"
    with _parsed_lightly(docs.sparkSession):
        out = docs.withColumn(name, F.expr(steps))
    joined = f"if({text} is null, cast(null as string), array_join(transform({name}, it -> it.t), ''))"
    return out.withColumn(name, F.expr(f"named_struct('text', {joined}, 'found', transform(filter({name}, it -> it.k <> ''), it -> it.k))")), name


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text column replaced; all other columns stay."""
    done, name = pseudonymised(docs, f"`{text_col}`", key)
    return done.withColumn(text_col, F.col(f"{name}.text")).drop(name)


def pseudonym_report(docs: DataFrame, *, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text (pseudonymised; null stays null), n_found, kinds (distinct, sorted, comma-joined)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    done, name = pseudonymised(rows, "text", key)
    found = F.col(f"{name}.found")
    return done.select("doc_id", F.col(f"{name}.text").alias("text"), F.size(found).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("kinds"))
