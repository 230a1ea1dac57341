"""Surrogates for personal data: keyed, of the same type and format, distinct and coreferent.

Entities are found by patterns (``TYPES``, tried in that order; names after a title only). An entity's
canonical form leaves out what is only writing (case of an address, separators
of a number); all its mentions get one surrogate.

* Everything but names goes through a keyed bijection of its format: a Feistel network over the
  places (digits, letters of either case, octets), each half being shifted place by place by a digest of the other.
  Digits stay digits and letters letters of the same case, at the same places; separators, lengths, a country, an
  issuer's first digit, the octets' numbers of digits and an e-mail's last label stay; equal hosts get equal hosts.
  Check digits of cards and IBANs are as right (or as wrong) as they were. Entities of one format
  cannot share a surrogate, those of two formats neither.
* A name becomes a name of its title's gender and of its own script (Latin, Cyrillic, Greek) and
  number of parts, built from syllables; an initial becomes a whole word.

Collision check, on the table of distinct entities: no surrogate may be an entity of the data, nor
two names' surrogates the same. Whoever collides tries the next bijection, or a name with one syllable more, ``ATTEMPTS``
times; only where the format has free places. Who finds none (a format that the data fill) gets
another such entity: those left of a format are exchanged in a ring of keyed order, so
surrogates stay distinct and nobody keeps the own value; one left alone keeps its first surrogate.
Only entities that did not keep their first surrogate travel back to the texts.

Texts are matched once and written in pieces; all later steps read these. Everything is DataFrame
code. Defined results: a null text stays null and has no
entity; repeated rows get the same replacement; a text with entities only is
replaced as a whole; an empty table gives an empty one. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobscope.llm.common import LOWER, UPPER, fresh
from jobscope.session import as_written

# Titles, names' syllables and endings: fixed values.
TITLES = {
    "m": ["Mr", "Mister", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Господин", "Г-н", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "Signora", "Госпожа", "Г-жа", "Κυρία"],
    "n": ["Dr", "Prof", "Professor"],
}
SYLLABLES = {
    "latin": ["ba", "ro", "mi", "te", "lu", "sa", "ke", "do", "vi", "na", "ge", "po", "ri", "fe", "mo", "la"],
    "cyrillic": ["ба", "ро", "ми", "те", "лу", "са", "ке", "до", "ви", "на", "ге", "по", "ри", "фе", "мо", "ла"],
    "greek": ["βα", "ρο", "μι", "τε", "λου", "σα", "κε", "δο", "βι", "να", "γε", "πο", "ρι", "φε", "μο", "λα"],
}
ENDINGS = {
    "latin": {"m": "n", "f": "na", "n": "r"},
    "cyrillic": {"m": "н", "f": "на", "n": "р"},
    "greek": {"m": "ς", "f": "να", "n": "ρ"},
}
OPEN, CLOSE = "\x01", "\x02"
STEPS = 6  # of the Feistel network
ATTEMPTS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# an initial, or a word with inner capitals and apostrophes (not the one of a genitive s)
PART = r"(?:\p{Lu}(?:\.|(?=[ -]\p{Lu}))|\p{Lu}(?:[\p{L}\p{M}]|['’](?=\p{Lu}|\p{Ll}{2}))++)"
NAME = rf"{PART}(?:(?:[ -]|(?<=\.)){PART})*+"
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": rf"(?<![\d.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d+])\d{4}(?:[ -]?\d{4}){3}(?!\d)|(?<![\d+])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "secret": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<=(?:password|passwd|secret|token|api_key)[=:])[A-Za-z0-9_-]{6,}",
    "name": rf"(?<![\p{{L}}-])(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? {NAME}",
}
ANY = "|".join(f"(?:{p})" for p in TYPES.values())
HINT = rf"[0-9@]|(?:password|passwd|secret|token|api_key)[=:]|(?:{'|'.join(t for g in TITLES.values() for t in g)})\.? \p{{Lu}}"


def entity_type(found: Column) -> Column:
    """Type of a text that one of the patterns found."""
    out = F.lit("name")
    for name, pattern in reversed(list(TYPES.items())):
        if name == "secret":  # its prefix is outside of what was found
            out = F.when(found.rlike(r"^[A-Za-z0-9_-]+$") & ~found.rlike(r"^\d{3}-\d{2}-\d{4}$|^\d{3}-\d{3}-\d{4}$|^\d{4}(-?\d{4}){3}$|^\d{15}$"), F.lit(name)).otherwise(out)
        elif name != "name":
            out = F.when(found.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, found: Column) -> Column:
    """The entity that a mention stands for."""
    plain = F.regexp_replace(found, r"[^\p{L}\p{N}]", "")
    return (
        F.when(kind == "email", F.lower(found))
        .when(kind.isin("card", "ssn", "phone", "iban"), plain)
        .otherwise(F.regexp_replace(found, r"\. ", " "))
    )


def _bound(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(digest: Column, place: Column) -> Column:
    """A number from 0 to 65535 for a place."""
    return F.pmod(F.xxhash64(digest, place), F.lit(65536)).cast("int")


def _shuffled(places: Column, seed: Column) -> Column:
    """Places (structs v, r with 0 <= v < r) to places of the same r: a keyed bijection."""

    def step(now: Column, k: Column) -> Column:
        half = (F.size(now) / 2).cast("int")
        first = k % 2 == 1
        other = F.when(first, F.slice(now, half + 1, F.size(now))).otherwise(F.slice(now, F.lit(1), half))
        digest = F.sha2(F.concat_ws("|", seed, k.cast("string"), F.array_join(F.transform(other, lambda p: p["v"].cast("string")), ",")), 256)

        def moved(d: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                v = F.when((i < half) == first, F.pmod(p["v"] + F.pmod(F.xxhash64(d, i), F.lit(1 << 40)), p["r"]).cast("int")).otherwise(p["v"])
                return F.struct(v.alias("v"), p["r"].alias("r"))

            return F.transform(now, one)

        return _bound(digest, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), places, step)


def _places(text: Column) -> Column:
    """Each character's place in its alphabet; what is no digit or Latin letter has one place only."""

    def one(c: Column) -> Column:
        code = F.ascii(c)
        digit, small, large = code.between(48, 57), code.between(97, 122), code.between(65, 90)
        v = F.when(digit, code - 48).when(small, code - 97).when(large, code - 65).otherwise(0)
        return F.struct(v.cast("int").alias("v"), F.when(digit, 10).when(small | large, 26).otherwise(1).alias("r"))

    return F.transform(F.split(text, ""), one)


def _letters(text: Column, seed: Column) -> Column:
    """Digits to digits, Latin letters to letters of the same case, the rest as it is; a bijection."""
    alphabets = F.lit("0123456789"), F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def one(c: Column, p: Column) -> Column:
        code = F.ascii(c)
        spot = p["v"] + 1
        return (
            F.when(p["r"] == 1, c)
            .when(code <= 57, F.substr(alphabets[0], spot, F.lit(1)))
            .when(code >= 97, F.substr(alphabets[1], spot, F.lit(1)))
            .otherwise(F.substr(alphabets[2], spot, F.lit(1)))
        )

    made = F.array_join(F.zip_with(F.split(text, ""), _shuffled(_places(text), seed), one), "")
    return F.when(F.char_length(text) == 0, text).otherwise(made)


def _octets(text: Column, seed: Column) -> Column:
    def read(part: Column) -> Column:
        size, n = F.char_length(part), part.cast("int")
        base = F.when(size == 1, 0).when(size == 2, 10).otherwise(100)
        return F.struct((n - base).alias("v"), F.when(size == 1, 10).when(size == 2, 90).otherwise(156).alias("r"))

    def write(p: Column) -> Column:
        return (p["v"] + F.when(p["r"] == 10, 0).when(p["r"] == 90, 10).otherwise(100)).cast("string")

    return F.array_join(F.transform(_shuffled(F.transform(F.split(text, r"\."), read), seed), write), ".")


def _luhn(payload: Column) -> Column:
    """The digit that makes payload a valid number."""
    n = F.char_length(payload)

    def one(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.transform(F.split(payload, ""), one), F.lit(0), lambda a, d: a + d)
    return F.pmod(-total, F.lit(10))


def _iban_check(country: Column, account: Column) -> Column:
    """The check number that makes an account valid: 98 - (account, country, 00 as a number) mod 97."""

    def one(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code <= 57, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), one)
    return F.lit(98) - rest


def _card(entity: Column, seed: Column) -> Column:
    """First digit kept; the last digit is off a valid one by as much as it was."""
    size = F.char_length(entity)
    head, old, last = F.substring(entity, 1, 1), F.substr(entity, F.lit(1), size - 1), F.substr(entity, size, F.lit(1)).cast("int")
    return _bound(
        F.concat(head, _letters(F.substr(entity, F.lit(2), size - 2), seed)),
        lambda new: F.concat(new, F.pmod(last - _luhn(old) + _luhn(new), F.lit(10)).cast("string")),
    )


def _iban(entity: Column, seed: Column) -> Column:
    """Country kept; the check number is off a valid one by as much as it was."""
    country, check, account = F.substring(entity, 1, 2), F.substring(entity, 3, 2).cast("int"), F.substr(entity, F.lit(5), F.char_length(entity))
    return _bound(
        _letters(account, seed),
        lambda new: F.concat(country, F.lpad(F.pmod(check - _iban_check(country, account) + _iban_check(country, new), F.lit(100)).cast("string"), 2, "0"), new),
    )


def _name(text: Column, digest: Column, attempt: Column) -> Column:
    """Title kept; each part a capitalised word of three syllables, one more at each attempt, and the gender's ending."""
    title = F.regexp_extract(text, r"^(\S+)", 1)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    rest = F.regexp_extract(text, r"^\S+ (.*)$", 1)
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    count = attempt + 3

    def body_of(parts: list[str], i: Column) -> Column:
        table = F.array(*[F.lit(p) for p in parts])
        return F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.element_at(table, _number(digest, i * count + k) % len(parts) + 1)), "")

    def word(i: Column) -> Column:
        out = F.lit(None).cast("string")
        for s, parts in SYLLABLES.items():
            body = body_of(parts, i)
            end = F.when(gender == "m", ENDINGS[s]["m"]).when(gender == "f", ENDINGS[s]["f"]).otherwise(ENDINGS[s]["n"])
            out = F.when(script == s, F.concat(body, end)).otherwise(out)
        return F.initcap(out)

    marks = F.regexp_extract_all(rest, F.lit(r"([ -])"), 1)
    words = F.transform(F.sequence(F.lit(0), F.size(marks)), word)
    joined = F.array_join(F.zip_with(words, marks, lambda w, m: F.concat(w, F.coalesce(m, F.lit("")))), "")
    return F.concat(title, F.lit(" "), joined)


def _kept(kind: Column, entity: Column) -> Column:
    """What stays at the beginning: a country, what is before ten digits of a number, a card's first digit, a secret's prefix."""
    return (
        F.when(kind == "iban", F.substring(entity, 1, 2))
        .when(kind == "phone", F.substr(entity, F.lit(1), F.greatest(F.lit(0), F.char_length(entity) - 10)))
        .when(kind == "card", F.substring(entity, 1, 1))
        .when(kind == "secret", F.regexp_extract(entity, "^((?:AKIA|ASIA)?)", 1))
        .otherwise(F.lit(""))
    )


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """Canonical surrogate of a canonical entity."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"))
    host = F.substring_index(entity, "@", -1)
    last = F.substring_index(host, ".", -1)
    labels = F.substr(host, F.lit(1), F.char_length(host) - F.char_length(last))
    # the host does not change with the attempt, so that equal hosts stay equal
    mail = F.concat(
        _letters(F.substring_index(entity, "@", 1), F.concat_ws("|", seed, host)), F.lit("@"), _letters(labels, F.lit(f"{key}|host")), last
    )
    kept = _kept(kind, entity)
    return (
        F.when(kind == "email", mail)
        .when(kind == "ip", _octets(entity, seed))
        .when(kind == "card", _card(entity, seed))
        .when(kind == "iban", _iban(entity, seed))
        .when(kind == "name", _name(entity, F.sha2(F.concat_ws("|", seed, entity), 256), attempt))
        .otherwise(F.concat(kept, _letters(F.substr(entity, F.char_length(kept) + F.lit(1)), seed)))
    )


def _format(kind: Column, entity: Column) -> Column:
    """Entities of one format have the same surrogates to choose from."""
    kept = _kept(kind, entity)
    pattern = lambda c: F.translate(c, "0123456789" + LOWER + UPPER, "0" * 10 + "a" * 26 + "A" * 26)
    return (
        F.when(kind == "email", F.concat_ws("@", pattern(F.substring_index(entity, "@", 1)), F.substring_index(entity, "@", -1)))
        .when(kind == "name", F.substring_index(entity, " ", 1))
        .otherwise(F.concat_ws("|", kept, pattern(F.substr(entity, F.char_length(kept) + F.lit(1)))))
    )


def _room(kind: Column, entity: Column) -> Column:
    """How many surrogates a format has (as a floating-point number); names have as many as are needed."""
    octets = F.transform(F.split(entity, r"\."), lambda p: F.when(F.char_length(p) == 1, 10.0).when(F.char_length(p) == 2, 90.0).otherwise(156.0))
    kept = _kept(kind, entity)
    body = F.when(kind == "email", F.substring_index(entity, "@", 1)).otherwise(F.substr(entity, F.char_length(kept) + F.lit(1)))
    sizes = F.when(kind == "ip", octets).otherwise(F.transform(_places(body), lambda p: p["r"].cast("double")))
    return F.when(kind == "name", float("inf")).otherwise(F.aggregate(sizes, F.lit(1.0), lambda a, x: a * x))


def written(kind: Column, found: Column, made: Column) -> Column:
    """The canonical surrogate in the writing of the mention (separators, capitals of an e-mail)."""

    def spread(now: Column, c: Column) -> Column:
        code = F.ascii(c)
        sign = code.between(48, 57) | code.between(65, 90) | code.between(97, 122)
        return F.struct(
            F.concat(now["out"], F.when(sign, F.substr(made, now["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (now["k"] + sign.cast("int")).alias("k")
        )

    separated = F.aggregate(F.split(found, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), spread)["out"]
    dotted = F.when(found.rlike(r"^\S+\. "), F.concat(F.regexp_extract(made, r"^(\S+)", 1), F.lit("."), F.regexp_extract(made, r"^\S+( .*)$", 1))).otherwise(made)
    return (
        F.when(kind == "email", F.when(found == F.upper(found), F.upper(made)).otherwise(made))
        .when(kind.isin("card", "ssn", "phone", "iban"), separated)
        .when(kind == "name", dotted)
        .otherwise(made)
    )


def matched(docs: DataFrame, text: str, columns: list[Column]) -> DataFrame:
    """columns, found (what the patterns find, in order), pieces (the text between); written, so that texts are matched once.

    A quick look settles most texts without digits. What is found is marked by two control
    characters and split there; a text that has one of them itself is matched a second time instead.
    """
    body = F.col(f"`{text}`")
    plain = ~body.contains(OPEN) & ~body.contains(CLOSE)
    marked = F.when(body.rlike(HINT) & plain, F.split(F.regexp_replace(body, ANY, f"{OPEN}$0{CLOSE}"), OPEN, -1))
    hard = body.rlike(HINT) & ~plain
    rows = docs.select(*columns, body.alias("_text"), marked.alias("_marked"), hard.alias("_hard"))
    later = F.slice("_marked", 2, F.greatest(F.size("_marked") - 1, F.lit(0)))
    none = F.array().cast("array<string>")
    found = F.when(F.col("_marked").isNotNull(), F.transform(later, lambda x: F.substring_index(x, CLOSE, 1)))
    pieces = F.when(
        F.col("_marked").isNotNull(),
        F.concat(F.slice("_marked", 1, 1), F.transform(later, lambda x: F.substr(x, F.char_length(F.substring_index(x, CLOSE, 1)) + F.lit(2)))),
    )
    return as_written(
        rows.select(
            *[c for c in rows.columns if c not in ("_text", "_marked", "_hard")],
            found.when(F.col("_hard"), F.regexp_extract_all("_text", F.lit(ANY), 0)).otherwise(none).alias("found"),
            pieces.when(F.col("_hard"), F.split("_text", ANY, -1)).when(F.col("_text").isNotNull(), F.array("_text")).alias("pieces"),
        ),
        "matched",
    )


def _distinct(found: DataFrame) -> DataFrame:
    return as_written(
        found.select(F.explode(F.array_distinct("found")).alias("found"))
        .select(entity_type(F.col("found")).alias("kind"), "found")
        .select("kind", canonical(F.col("kind"), F.col("found")).alias("entity")).distinct(),
        "entities",
    )


def _settle(real: DataFrame, key: str) -> DataFrame:
    """kind, entity, attempt, made for every entity; attempt is null where the ring of the left ones gave it."""
    kind, entity = F.col("kind"), F.col("entity")
    todo = as_written(real.withColumns({"attempt": F.lit(0), "made": surrogate(kind, entity, F.lit(0), key)}), "surrogates")
    settled = None
    for attempt in range(1, ATTEMPTS + 1):
        met = as_written(todo.join(real.select("kind", F.col("entity").alias("made")), ["kind", "made"]).select("kind", "made").distinct(), "met")
        if settled is not None:
            met = as_written(met.union(todo.join(settled.select("kind", "made"), ["kind", "made"]).select("kind", "made").distinct()).distinct(), "met")
        # bijections of one attempt cannot meet each other, names can
        same = Window.partitionBy("kind", "made").orderBy("entity")
        names = todo.filter(kind == "name").withColumn("_place", F.row_number().over(same)).filter("_place > 1").select("kind", "entity", F.lit(True).alias("_again"))
        checked = as_written(
            todo.join(met.withColumn("_met", F.lit(True)), ["kind", "made"], "left").join(names, ["kind", "entity"], "left")
            .select("kind", "entity", "attempt", "made", (F.col("_met").isNotNull() | F.col("_again").isNotNull()).alias("_bad")),
            "checked",
        )
        good = checked.filter(~F.col("_bad")).drop("_bad")
        settled = good if settled is None else settled.union(good)
        bad = checked.filter("_bad").select("kind", "entity")
        if bad.isEmpty():
            return settled
        if attempt == 1:  # formats that the data fill have nothing to try for
            formats = bad.select(_format(kind, entity).alias("format"), "kind").distinct()
            full = as_written(
                real.withColumn("format", _format(kind, entity)).join(formats, ["kind", "format"])
                .groupBy("kind", "format").agg(F.count(F.lit(1)).alias("n"), F.max(_room(kind, entity)).alias("room")).filter("n >= room").select("kind", "format"),
                "full-formats",
            )
            known = as_written(bad.withColumn("format", _format(kind, entity)), "left")
            ring, bad = known.join(full, ["kind", "format"], "left_semi"), known.join(full, ["kind", "format"], "left_anti").drop("format")
        todo = as_written(bad.withColumns({"attempt": F.lit(attempt), "made": surrogate(kind, entity, F.lit(attempt), key)}), "surrogates")
        if todo.isEmpty():
            break
    else:
        ring = ring.unionByName(todo.select("kind", "entity", _format(kind, entity).alias("format")))
    order = Window.partitionBy("kind", "format").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "entity"), 256))
    all_of = Window.partitionBy("kind", "format")
    following = F.coalesce(F.lead("entity").over(order), F.first("entity").over(order))
    alone = F.count(F.lit(1)).over(all_of) == 1
    return settled.union(
        ring.select("kind", "entity", F.lit(None).cast("int").alias("attempt"), F.when(alone, surrogate(kind, entity, F.lit(0), key)).otherwise(following).alias("made"))
    )


def entities(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind, entity, attempt, made of every distinct entity; made is distinct within a kind and, where its format has room, no entity of it."""
    return _settle(_distinct(matched(docs, text, [])), key)


def replace(docs: DataFrame, key: str, text: str = "text", keep: list[str] | None = None, out: str = "safe") -> DataFrame:
    """The rows of docs (columns ``keep``, by default all) with a struct column ``out``.

    text with surrogates, n_mentions, n_entities (distinct), kinds (distinct, sorted). Who knows
    the key can find out what a surrogate stands for.
    """
    keep = docs.columns if keep is None else keep
    body = F.col(f"`{text}`")
    known = F.struct(F.xxhash64(body).alias("t1"), F.xxhash64(F.lit("text"), body).alias("t2"))
    rows = matched(docs, text, [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), known.alias("_t")])
    later = as_written(
        _settle(_distinct(rows), key).filter("attempt is null or attempt > 0").select("kind", "entity", "made"), "later-surrogates"
    )
    # the few entities that did not keep the first surrogate, by text: equal texts have the same ones
    exceptions = as_written(
        rows.select("_t", F.explode(F.array_distinct("found")).alias("found"))
        .select("_t", entity_type(F.col("found")).alias("kind"), "found")
        .select("_t", "kind", canonical(F.col("kind"), F.col("found")).alias("entity"))
        .join(later, ["kind", "entity"])
        .groupBy("_t").agg(F.collect_set(F.struct(F.concat_ws("|", "kind", "entity"), "made")).alias("_later"))
        .select(F.col("_t").alias("_u"), F.map_from_entries("_later").alias("_later")),
        "exceptions",
    )
    joined = rows.join(exceptions, F.col("_t") == F.col("_u"), "left")

    def one(found: Column) -> Column:
        return _bound(entity_type(found), lambda kind: _bound(canonical(kind, found), lambda entity: _bound(
            F.coalesce(F.element_at(F.col("_later"), F.concat_ws("|", kind, entity)), surrogate(kind, entity, F.lit(0), key)),
            lambda made: F.struct(kind.alias("kind"), entity.alias("entity"), written(kind, found, made).alias("made")),
        )))

    joined = joined.select("_row", "pieces", F.transform("found", one).alias("_made"))
    whole = F.array_join(
        F.zip_with("pieces", F.transform("_made", lambda x: x["made"]), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), ""
    )
    distinct = F.array_distinct(F.transform("_made", lambda x: F.struct(x["kind"], x["entity"])))
    changed = joined.select(
        "_row", whole.alias("text"), F.size("_made").cast("bigint").alias("n_mentions"), F.size(distinct).cast("bigint").alias("n_entities"),
        F.array_sort(F.array_distinct(F.transform("_made", lambda x: x["kind"]))).alias("kinds"),
    )
    return changed.select(*[F.col("_row")[c].alias(c) for c in keep], F.struct("text", "n_mentions", "n_entities", "kinds").alias(fresh(out, keep)))
