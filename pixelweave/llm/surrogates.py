"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Entities are cut into units (the local part and the domain of an address, the
digits of a number, the words of a name) and every distinct unit of the corpus
gets one surrogate, so a unit reads the same wherever it occurs and in whatever
format. Surrogates come from a keyed hash; units of one kind whose surrogates
collide, with each other or with a real unit of the corpus, draw again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelweave.operators.blocks import dense_index
from pixelweave.session import cut_lineage

WORD = r"\p{L}\p{N}._%+\-"
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа"]
PATTERN = "|".join([
    rf"(?<![{WORD}])[{WORD}]++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)+",  # addresses
    r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d]|\.\d)",  # IPv4
    r"(?<![\d+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)",  # telephone, area in brackets
    r"(?<!\d)\+\d{1,3}(?:[ .\-]?\d{2,4}){2,3}(?!\d)",  # telephone with country
    r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",  # keys
    r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",  # cards and accounts
    rf"(?<!\p{{L}})(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? \p{{Lu}}[\p{{L}}'\-]+(?: \p{{Lu}}[\p{{L}}'\-]+)?",
])
DIGITS, LATIN = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω"
#: Given names a surrogate starts from, by script and gender.
GIVEN = {("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Karim", "Leon", "Martin", "Oscar"],
         ("latin", "f"): ["Alma", "Bianca", "Clara", "Dora", "Elena", "Frida", "Greta", "Helena", "Irma", "Julia", "Laura", "Marta"],
         ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"],
         ("cyrillic", "f"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"]}


#: Draws of a number before its kind and length count as full.
DRAWS = 16


def _byte(h: Column, i: Column) -> Column:
    """Number 0 to 255 at place i of a hex digest, going round."""
    at = (i % 64) * 2 + 1
    hexes = F.lit("0123456789abcdef")
    return (F.position(F.substring(h, at, 1), hexes) - 1) * 16 + F.position(F.substring(h, at + 1, 1), hexes) - 1


def _pick(table: str, n: Column) -> Column:
    return F.substring(F.lit(table), n % len(table) + 1, F.lit(1))


def _drawn(text: Column, h: Column) -> Column:
    """Each letter and digit redrawn in its script; everything else kept."""
    def one(c, i):
        n = _byte(h, i)
        return (F.when(c.rlike("[0-9]"), _pick(DIGITS, n)).when(c.rlike(r"\p{IsCyrillic}"), _pick(CYRILLIC, n))
                 .when(c.rlike(r"\p{IsGreek}"), _pick(GREEK, n)).when(c.rlike(r"\p{L}|\p{N}"), _pick(LATIN, n)).otherwise(c))

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")


def _surrogate(kind: Column, unit: Column, h: Column) -> Column:
    """The surrogate of a unit, in lower case."""
    cyrillic = unit.rlike(r"\p{IsCyrillic}")

    def given(gender):
        def of(names):
            return F.get(F.array(*map(F.lit, names)), _byte(h, F.lit(60)) % len(names))
        return F.lower(F.when(cyrillic, of(GIVEN["cyrillic", gender])).otherwise(of(GIVEN["latin", gender])))

    def hexes(text):
        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""),
                                        lambda c, i: _pick("0123456789abcdef", _byte(h, i))), "")

    tld = F.regexp_extract(unit, r"\.[^.]*$", 0)
    return (F.when(kind == "domain", F.concat(_drawn(F.regexp_replace(unit, r"\.[^.]*$", ""), h), tld))
             .when(kind == "ip", F.concat_ws(".", *((_byte(h, F.lit(i)) % 254 + 1).cast("string") for i in range(4))))
             .when(kind == "key", hexes(unit))
             .when(kind == "given_m", F.concat(given("m"), _drawn(F.substring(unit, 1, 2), h)))
             .when(kind == "given_f", F.concat(given("f"), _drawn(F.substring(unit, 1, 2), h)))
             .otherwise(_drawn(unit, h)))


def _kind(e: Column) -> Column:
    return (F.when(e.contains("@"), "email").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
             .when(e.rlike(r"^[+(]"), "phone").when(e.rlike(r"^[0-9 \-]+$"), "card").when(e.rlike("^[0-9a-fA-F]{32,}$"), "key")
             .otherwise("name"))


def _units(e: Column, kind: Column) -> Column:
    """The units of an entity, in order: array of (kind, unit)."""
    def unit(k, value):
        return F.struct((F.lit(k) if isinstance(k, str) else k).alias("kind"), value.alias("unit"))

    low, digits = F.lower(e), F.regexp_replace(F.regexp_replace(e, r"^\+\d{1,3}(?=[ .(\-])", ""), r"\D", "")
    words = F.split(low, " ")
    title = F.regexp_replace(F.get(F.split(e, " "), F.lit(0)), r"\.$", "")
    given = F.when(title.isin(MALE), "given_m").otherwise("given_f")
    return (F.when(kind == "email", F.array(unit("local", F.substring_index(low, "@", 1)), unit("domain", F.substring_index(low, "@", -1))))
             .when(kind == "name", F.when(F.size(words) > 2, F.array(unit(given, F.get(words, F.lit(1))), unit("surname", F.get(words, F.lit(2)))))
                   .otherwise(F.array(unit("surname", F.get(words, F.lit(1))))))
             .otherwise(F.array(unit(kind, F.when(kind.isin("phone", "card"), digits).otherwise(low)))))


def _rewritten(e: Column, kind: Column, new: Column) -> Column:
    """The entity with the surrogates of its units, in the entity's own format and case."""
    first, second = F.get(new, F.lit(0)), F.get(new, F.lit(1))
    country = F.regexp_extract(e, r"^\+\d{1,3}(?=[ .(\-])", 0)
    rest = F.substring(e, F.length(country) + 1, F.length(e))

    def refill(c, i):
        before = F.length(F.regexp_replace(F.substring(rest, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substring(first, before + 1, F.lit(1))).otherwise(c)

    digits = F.concat(country, F.array_join(F.transform(F.filter(F.split(rest, ""), lambda c: c != ""), refill), ""))
    title = F.get(F.split(e, " "), F.lit(0))
    names = F.concat_ws(" ", title, *(F.when(F.get(F.split(e, " "), F.lit(2)).rlike(r"^\p{Lu}{2,}$") | F.get(F.split(e, " "), F.lit(1)).rlike(r"^\p{Lu}{2,}$"),
                                             F.upper(x)).otherwise(F.initcap(x)) for x in (first, second)))
    plain = F.when(kind == "email", F.concat_ws("@", first, second)).otherwise(first)
    plain = F.when((e == F.upper(e)) & (e != F.lower(e)), F.upper(plain)).otherwise(plain)
    return F.when(kind == "name", names).when(kind.isin("phone", "card"), digits).otherwise(plain)


def _turned(units: DataFrame, key: str) -> DataFrame:
    """``kind, unit, surrogate``: units of one kind and length in a keyed order, each with the next one's value, the last with the first's."""
    h = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit("cycle"), "kind", "unit"), 256)
    ranked = dense_index(units.withColumn("h", h), ["kind", "length"], ["h", "unit"], F.substring("h", 1, 4), "i", "size")
    ranked = cut_lineage(ranked.select("kind", "length", "unit", "i", "size"))
    after = ranked.select("kind", "length", F.pmod(F.col("i") - 1, "size").alias("i"), F.col("unit").alias("surrogate"))
    return ranked.join(after, ["kind", "length", "i"]).select("kind", "unit", "surrogate")


def assign(units: DataFrame, key: str) -> DataFrame:
    """``kind, unit, surrogate``: an injective, keyed choice for distinct units (``kind, unit``).

    Of units of one kind that draw the same surrogate the least keeps it; the
    others, and those whose surrogate is a unit of the corpus, draw again. A draw
    depends on the key, the unit and the number of the draw alone. Later draws of
    names and addresses are longer, so they have room for any corpus. Numbers
    keep their digits: where the corpus holds so many of one length that some are
    left after DRAWS draws, all numbers of that kind and length trade places
    along one keyed cycle, so each has another's value and none its own (a length
    is only so full with several of them).
    """
    real = units.select("kind", F.col("unit").alias("surrogate"))
    done, waiting, turn = None, units, 0
    while True:
        h = F.sha2(F.concat_ws("\u0001", F.lit(key), F.lit(turn).cast("string"), "kind", "unit"), 512)
        padded = F.concat("unit", F.lit("a" * (turn // 8))) if turn >= 8 else F.col("unit")
        padded = F.when(F.col("kind").isin("local", "domain", "surname", "given_m", "given_f"), padded).otherwise(F.col("unit"))
        drawn = waiting.select("kind", "unit", _surrogate(F.col("kind"), padded, h).alias("surrogate"))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["kind", "surrogate"], "left_anti")
        won = cut_lineage(free.groupBy("kind", "surrogate").agg(F.min("unit").alias("unit")).select("kind", "unit", "surrogate"))
        done = won if done is None else done.unionByName(won)
        waiting = cut_lineage(waiting.join(won, ["kind", "unit"], "left_anti"))
        turn += 1
        if waiting.isEmpty():
            return done
        if turn >= DRAWS:
            full = cut_lineage(waiting.filter(F.col("kind").isin("phone", "card")).select("kind", F.length("unit").alias("length")).distinct())
            if turn % DRAWS == 0 and not full.isEmpty():
                sized = [d.withColumn("length", F.length("unit")) for d in (units, done, waiting)]
                moved = _turned(sized[0].join(full, ["kind", "length"]), key)
                done = sized[1].join(full, ["kind", "length"], "left_anti").select("kind", "unit", "surrogate").unionByName(moved)
                waiting = sized[2].join(full, ["kind", "length"], "left_anti").select("kind", "unit")
                done, waiting = cut_lineage(done), cut_lineage(waiting)
                if waiting.isEmpty():
                    return done


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and ``n_entities`` (long).

    Found are addresses, IPv4 numbers, telephone numbers, card and account
    numbers, hexadecimal keys, and names after a title (whose gender the given
    name follows). Equal units get equal surrogates, different ones different
    surrogates of the same kind; digits, separators, case, script and the last
    label of a domain stay as they were formatted.

    Only occurrences are shuffled, as entity texts; an entity that a third of
    the documents hold is a hot join key, which adaptive execution splits. Texts
    without entities, null and empty ones come back as they are. Rows of one id
    and text are rewritten alike. An empty table gives no rows.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"),
                       F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(text_col).alias("stamp")).alias("at"))
    found = cut_lineage(rows.select("at", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("entities"))
                            .filter(F.size("entities") > 0).dropDuplicates(["at"]))
    distinct = found.select(F.explode("entities").alias("e")).distinct().withColumn("kind", _kind(F.col("e")))
    parts = cut_lineage(distinct.select("e", F.posexplode(_units(F.col("e"), F.col("kind"))).alias("i", "u"))
                                .select("e", "i", "u.kind", "u.unit"))
    chosen = assign(cut_lineage(parts.select("kind", "unit").distinct()), key)
    new = (parts.join(chosen, ["kind", "unit"]).groupBy("e")
                .agg(F.array_sort(F.collect_list(F.struct("i", "surrogate"))).getField("surrogate").alias("new")))
    new = new.select("e", _rewritten(F.col("e"), _kind(F.col("e")), F.col("new")).alias("text"))
    replaced = (found.select("at", F.posexplode("entities").alias("i", "e")).join(new, "e").groupBy("at")
                     .agg(F.array_sort(F.collect_list(F.struct("i", "text"))).getField("text").alias("_new")))
    has = F.coalesce(F.col("text").rlike(PATTERN), F.lit(False))
    pieces = F.split("text", PATTERN, -1)
    woven = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit("")))), "")
    changed = rows.filter(has).join(replaced.withColumnRenamed("at", "_at"), F.col("at").eqNullSafe(F.col("_at")))

    def shaped(df, text, n):
        return df.select(*(text.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns),
                         n.cast("long").alias("n_entities"))

    return shaped(changed, woven, F.size("_new")).unionByName(shaped(rows.filter(~has), F.col("text"), F.lit(0)))
