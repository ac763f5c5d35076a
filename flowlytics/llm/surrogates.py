"""Surrogates for personal data: keyed, type-consistent and distinct replacements.

Entities are found by patterns. An entity's identity (its canonical form: letters in lower case, no punctuation) seeds a
keyed stream, from which each letter and digit is replaced by another of its class and case; punctuation stays, as do the
parts that make the format (top-level domain, leading digit, key prefix). Octets stay octets, card numbers keep a valid
check digit, names get a name of the same script and gender. All forms of an identity get the same surrogate in their own
format, in all documents. Surrogates are checked over the whole corpus: where two identities would share one, or one is
itself an identity of the corpus, all but the first are drawn again, until none is left.

Only DataFrame functions run here: the entities of a document are cut out, distinct ones get surrogates by a small table, and
the text is put together again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowlytics.sources.stage import materialise

# fixed values: forms of address by gender, with the names after them
MALE = "Mr|Mister|Sir|Herr|Herrn|Monsieur|Señor|Don|господин|κύριος"
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Doña|госпожа|κυρία"
PERSON = "Dr|Doctor|Prof|Professor"
NAME = "\\p{Lu}\\p{Ll}++(?:-\\p{Lu}\\p{Ll}++)?"


def _titled(titles: str) -> str:
    """Up to three capitalised names (the group) after a form of address."""
    return f"(?<![\\p{{L}}])(?:{titles})\\.? ({NAME}(?: {NAME}){{0,2}})(?![\\p{{L}}])"


# kind, pattern; of two that fit at one place the first counts
PATTERNS = [
    ("email", "(?<![\\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\\.){1,8}[A-Za-z]{2,24}(?![\\w-])"),
    ("ip", "(?<![\\w.])(?:(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)\\.){3}(?:25[0-5]|2[0-4]\\d|1?\\d?\\d)(?![\\w]|\\.\\d)"),
    ("card", "(?<![\\w.+-])(?:\\d{4}(?:[ -]?\\d{4}){3}|3[47]\\d{2}[ -]?\\d{6}[ -]?\\d{5})(?![\\w]|[.-]\\d)"),
    ("phone", "(?<![\\w.])\\+\\d{1,3}[ .-]?\\(?\\d{1,4}\\)?(?:[ .-]?\\d{2,4}){2,4}(?!\\w)|(?<![\\w.])\\(\\d{3}\\) ?\\d{3}-\\d{4}(?!\\w)|(?<![\\w.+-])\\d{3}-\\d{3}-\\d{4}(?!\\w|-\\d)"),
    ("key", "(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"),
    ("hex", "(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])"),
    ("password", "(?<=(?<![A-Za-z0-9])password[=:] ?)[^\\s\"']{6,}"),
]
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
PLAIN = "|".join(f"(?:{p})" for k, p in PATTERNS if k in ("email", "ip", "card", "phone", "hex"))
TITLES = {"male": MALE, "female": FEMALE, "person": PERSON}
# what a text must hold for names and the kinds that PLAIN leaves out; without any it takes the shorter pattern
RARE = ("AKIA", "password", *MALE.split("|"), *FEMALE.split("|"), *(t + end for t in PERSON.split("|") for end in " ."))
DRAWN_A_TASK = 5_000  # identities
MOST_PLAIN = 8  # drawn so often within the format; after that the surrogate gets longer

# syllables of made-up names by script, and endings by script and gender (fixed values)
SYLLABLES = {"latin": "ba be bo da de di do fa fe ga ge ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se so ta te to va ve",
             "cyrillic": "ба бе бо ва ве га да де жа зе ка ко ла ле ли ма ми на не но па ра ре ро са се та те то ха",
             "greek": "βα γα δα δε ζη θα κα κο λα λε λι μα με μι να νε νι πα πο ρα ρε σα σε τα τε τι φα χα"}
ENDINGS = {("latin", "male"): "n", ("latin", "female"): "na", ("cyrillic", "male"): "в", ("cyrillic", "female"): "ва", ("greek", "male"): "ς", ("greek", "female"): "",
           ("latin", "person"): "l", ("cyrillic", "person"): "л", ("greek", "person"): "λ"}


def kind_of(surface: Column) -> Column:
    """The kind by shape; a name's kind comes from the form of address before it and can't be told from the name alone."""
    return (F.when(surface.contains("@") & surface.rlike(f"^(?:{PATTERNS[0][1]})$"), "email")
            .when(surface.rlike(f"^(?:{PATTERNS[1][1]})$"), "ip").when(surface.rlike(f"^(?:{PATTERNS[2][1]})$"), "card")
            .when(surface.rlike(f"^(?:{PATTERNS[3][1]})$"), "phone").when(surface.rlike("^AKIA[A-Z0-9]{16}$"), "key")
            .when(surface.rlike("^[0-9a-f]{40}$"), "hex"))


def _rare(text: Column) -> Column:
    out = F.lit(False)
    for word in RARE:
        out = out | text.contains(word)
    return out


def _names_pattern(text: Column) -> Column:
    """The pattern of a text in which forms of address stand before names, with all further mentions of these; else null."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(_titled(t)), F.lit(1)) for t in TITLES.values()))
    names = F.array_distinct(F.flatten(F.transform(found, lambda x: F.split(x, " "))))
    longest = F.array_sort(names, lambda a, b: F.length(b) - F.length(a))
    whole = F.concat(F.lit(f"{ANY}|(?<![\\p{{L}}])(?:"), F.array_join(longest, "|"), F.lit(")(?![\\p{L}])"))
    return F.when(_rare(text) & (F.size(names) > 0), whole)


def entities(docs: DataFrame) -> DataFrame:
    """doc_id, copy, pos, kind, surface of each entity, once for rows that repeat. ``docs``: doc_id, copy, text."""
    t, named = F.col("text"), F.col("named")
    rows = docs.withColumn("rare", _rare(t)).filter(F.col("rare") | t.rlike("[@0-9]|[a-f]{40}")).withColumn("named", _names_pattern(t))
    surfaces = (F.when(named.isNotNull(), F.regexp_extract_all(t, named, F.lit(0))).when(F.col("rare"), F.regexp_extract_all(t, F.lit(ANY), F.lit(0)))
                .otherwise(F.regexp_extract_all(t, F.lit(PLAIN), F.lit(0))))
    # the end of what stands before each: enough for a form of address
    leads = F.transform(_pieces(t, F.col("rare"), named), lambda p: F.struct(F.right(p, F.lit(64)).alias("lead"), (F.length(p) == 1).alias("one")))
    cut = rows.select("doc_id", "copy", F.posexplode(F.arrays_zip(surfaces.alias("surface"), leads.alias("before"))).alias("pos", "e"))
    cut = cut.select("doc_id", "copy", "pos", F.col("e.surface").alias("surface"), F.col("e.before.lead").alias("lead"), F.col("e.before.one").alias("one")).filter("surface IS NOT NULL")
    cut = cut.dropDuplicates(["doc_id", "copy", "pos"])
    lead = F.col("lead")
    plain = F.coalesce(kind_of(F.col("surface")), F.when(lead.rlike("(?<![A-Za-z0-9])password[=:] ?$"), "password"))
    title = F.lit(None).cast("string")
    for kind, titles in TITLES.items():
        title = F.coalesce(title, F.when(lead.rlike(f"(?<![\\p{{L}}])(?:{titles})\\.? $"), kind))
    cut = cut.withColumn("plain", plain).withColumn("titled", F.when(F.col("plain").isNull(), title))
    # second and third names are of the first one's kind
    w = Window.partitionBy("doc_id", "copy").orderBy("pos")
    for _ in range(2):
        before = F.when(F.col("one") & (lead == " ") & F.col("plain").isNull(), F.lag("titled").over(w))
        cut = cut.withColumn("titled", F.coalesce("titled", before))
    # further mentions are of the kind of the last one that is known, or the first
    same = Window.partitionBy("doc_id", "copy", "surface").orderBy("pos")
    last = F.last("titled", True).over(same.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    first = F.first("titled", True).over(same.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return cut.select("doc_id", "copy", "pos", F.coalesce("plain", last, first, F.lit("person")).alias("kind"), "surface")


def _pieces(text: Column, rare: Column, named: Column) -> Column:
    """What stands between the entities."""
    return F.when(named.isNotNull(), F.split(text, named)).when(rare, F.split(text, F.lit(ANY))).otherwise(F.split(text, F.lit(PLAIN)))


def canonical(kind: Column, surface: Column) -> Column:
    """One form for all ways to write an entity."""
    return (F.when(kind.isin("password", "key", "hex"), surface).when(kind.isin("phone", "card"), F.concat(F.when(surface.startswith("+"), "+").otherwise(""), F.regexp_replace(surface, "\\D", "")))
            .otherwise(F.lower(surface)))


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) number below 65536 of a hexadecimal stream."""
    return F.conv(F.substring(stream, i * 4 + 1, 4), 16, 10).cast("int")


def _stream(key: str, kind: Column, identity: Column, attempt: Column, length: Column) -> Column:
    """Keyed hexadecimal digits, four for each of ``length`` characters."""
    seed = F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), identity)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(length / 32).cast("int")), lambda j: F.sha2(F.concat_ws("#", seed, j.cast("string")), 512))
    return F.array_join(blocks, "")


def _replaced(surface: Column, stream: Column, fixed: Column, by_place: bool = False) -> Column:
    """Each ASCII letter and digit replaced by another of its class, from the ``fixed``-th (by count of letters and digits) on.

    ``by_place`` takes the stream by the character's place: for entities of any length that are written in one way only.
    """
    ordinal = lambda i: i if by_place else F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), "[^A-Za-z0-9]", "")) - 1

    def one(c: Column, i: Column) -> Column:
        at = ordinal(i)
        n = _byte(stream, at)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))
        return (F.when(at < fixed, c).when(c.rlike("^[0-9]$"), (n % 10).cast("string")).when(c.rlike("^[a-z]$"), letter)
                .when(c.rlike("^[A-Z]$"), F.upper(letter)).otherwise(c))

    return F.array_join(F.transform(F.split(surface, ""), one), "")


def _octets(surface: Column, stream: Column, wide: Column) -> Column:
    """Octets of as many digits each; of any size where ``wide``."""
    def one(octet: Column, i: Column) -> Column:
        n = _byte(stream, i)
        return F.when(wide, n % 256).when(F.length(octet) == 1, n % 10).when(F.length(octet) == 2, n % 90 + 10).otherwise(n % 156 + 100).cast("string")

    return F.array_join(F.transform(F.split(surface, "\\."), one), ".")


def _checked(card: Column) -> Column:
    """The card number with its last digit made valid (Luhn)."""
    digits = F.split(F.regexp_replace(card, "\\D", ""), "")
    doubled = lambda d, i: F.when((F.size(digits) - i) % 2 == 0, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d)
    body = F.transform(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda d, i: doubled(d.cast("int"), i))
    total = F.aggregate(body, F.lit(0), lambda a, b: a + b)
    return F.concat(F.substring(card, F.lit(1), F.length(card) - 1), ((10 - total % 10) % 10).cast("string"))


def _script(name: Column) -> Column:
    return F.when(name.rlike("^\\p{IsCyrillic}"), "cyrillic").when(name.rlike("^\\p{IsGreek}"), "greek").otherwise("latin")


def _drawn(pool: Column, stream: Column, start: Column, more: Column) -> Column:
    """Four syllables, and ``more``, from the stream."""
    return F.transform(F.sequence(F.lit(0), more.cast("int") + 3), lambda j: F.get(pool, _byte(stream, start + j) % F.size(pool)))


def _name(kind: Column, surface: Column, stream: Column, more: Column) -> Column:
    """A made-up name of the script and gender; double names stay double."""
    script = _script(surface)

    def part(_: Column, at: Column) -> Column:
        out = None
        for s, syllables in SYLLABLES.items():
            pool = F.array(*map(F.lit, syllables.split()))
            drawn = _drawn(pool, stream, at * 8, more)
            ending = F.when(kind == "male", ENDINGS[s, "male"]).when(kind == "female", ENDINGS[s, "female"]).otherwise(ENDINGS[s, "person"])
            whole = F.initcap(F.concat(F.array_join(drawn, ""), ending))
            out = F.when(script == s, whole) if out is None else out.when(script == s, whole)
        return out

    return F.array_join(F.transform(F.split(surface, "-"), part), "-")


def surrogate(key: str, kind: Column, surface: Column, identity: Column, attempt: Column) -> Column:
    """The surrogate of one way to write an identity, in that way's format."""
    drawn = _stream(key, kind, identity, attempt, F.greatest(F.length(surface), F.lit(40)))
    # bound by a lambda, the stream is made once and not for each character
    return F.get(F.transform(F.array(drawn), lambda stream: _by_kind(kind, surface, attempt, stream)), F.lit(0))


def _by_kind(kind: Column, surface: Column, attempt: Column, stream: Column) -> Column:
    wide = attempt >= MOST_PLAIN
    longer = F.when(wide, F.concat(F.lit("x"), F.left(F.sha2(stream, 256), F.lit(8)))).otherwise("")
    top = F.concat(F.lit("."), F.substring_index(surface, ".", -1))
    address = _replaced(F.substring(surface, F.lit(1), F.length(surface) - F.length(top)), stream, F.lit(0))
    mail = F.concat(F.substring_index(address, "@", 1), longer, F.lit("@"), F.substring_index(address, "@", -1), top)
    return (F.when(kind == "email", mail).when(kind == "ip", _octets(surface, stream, wide))
            .when(kind == "card", _checked(_replaced(surface, stream, F.when(F.length(F.regexp_replace(surface, "\\D", "")) == 15, 2).otherwise(1))))
            .when(kind == "phone", _replaced(surface, stream, F.when(surface.startswith("+"), 1).otherwise(0)))
            .when(kind == "key", _replaced(surface, stream, F.lit(4)))
            .when(kind == "hex", F.left(F.sha2(stream, 512), F.lit(40)))
            .when(kind == "password", F.concat(_replaced(surface, stream, F.lit(0), by_place=True), longer))
            .otherwise(_name(kind, surface, stream, F.when(wide, 2).otherwise(0))))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """kind, surface, surrogate for the distinct entities (kind, surface), without collisions between identities."""
    forms = materialise(entities.withColumn("identity", canonical(F.col("kind"), F.col("surface"))))
    people = materialise(forms.groupBy("kind", "identity").agg(F.min("surface").alias("form")))
    taken = people.select("kind", F.col("identity").alias("look"))  # what originals look like; no surrogate may be one
    todo, attempt, settled = people.withColumn("attempt", F.lit(0)), 0, None
    while True:
        spread = todo.repartition(max(1, -(-todo.count() // DRAWN_A_TASK)), "kind", "identity")
        drawn = spread.withColumn("look", canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("form"), F.col("identity"), F.col("attempt"))))
        drawn = materialise(drawn)
        free = drawn.join(taken, ["kind", "look"], "left_anti")
        winners = free.groupBy("kind", "look").agg(F.min("identity").alias("identity"))
        good = materialise(drawn.join(winners, ["kind", "look", "identity"], "left_semi").select("kind", "identity", "attempt", "look"))
        settled = good if settled is None else settled.unionAll(good)
        rest = materialise(drawn.join(good, ["kind", "identity"], "left_anti").select("kind", "identity", "form"))
        if rest.isEmpty():
            break
        attempt += 1
        taken = taken.unionAll(good.select("kind", "look"))
        todo = rest.withColumn("attempt", F.lit(attempt))
    made = materialise(forms.join(settled.select("kind", "identity", "attempt"), ["kind", "identity"]))
    made = made.repartition(max(1, -(-made.count() // DRAWN_A_TASK)), "kind", "surface")
    return made.select("kind", "surface", surrogate(key, F.col("kind"), F.col("surface"), F.col("identity"), F.col("attempt")).alias("surrogate"))


def with_surrogates(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text (entities replaced), n_entities.

    A null text comes back null, an empty one empty, both without entities; text outside of entities is unchanged. Repeated
    rows get the same result each. An empty table gives no row. Other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    seen = materialise(entities(rows))
    table = materialise(surrogate_table(seen.select("kind", "surface").distinct(), key))
    per_doc = (seen.join(table, ["kind", "surface"]).groupBy(F.col("doc_id").alias("of"), F.col("copy").alias("of_copy"))
               .agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))).alias("made")))
    per_doc = materialise(per_doc.select("of", "of_copy", F.transform("made", lambda m: m["surrogate"]).alias("made")))
    # always by a merge join, so that the plan is the same at every size
    joined = rows.join(per_doc.hint("merge"), rows["doc_id"].eqNullSafe(per_doc["of"]) & (rows["copy"] == per_doc["of_copy"]), "left")
    joined = joined.withColumn("named", F.when(F.col("made").isNotNull(), _names_pattern(F.col("text"))))
    rebuilt = F.array_join(F.zip_with(_pieces(F.col("text"), _rare(F.col("text")), F.col("named")), F.col("made"), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    return joined.select("doc_id", F.when(F.col("made").isNull(), F.col("text")).otherwise(rebuilt).alias("text"),
                         F.coalesce(F.size("made"), F.lit(0)).cast("long").alias("n_entities"))
