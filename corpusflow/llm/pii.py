"""Operator 6: PII replaced by surrogates (DataFrame functions only).

Method: detected entities (e-mail, IPv4, card, phone, social security number, IBAN, titled
name) are replaced in place by surrogates derived from a keyed hash of the normalised
entity: the same entity gets the same surrogate wherever and however it is written
(coreference), of the same type and format: digits stay digits in the same layout, card
numbers that pass the Luhn test get surrogates that pass, names keep their title and get a
name of the same gender and script, e-mail addresses keep their shape under a reserved
top-level domain.

Numbers (phones, cards, social security numbers, IPv4) go through a keyed permutation of the
values of their format, so distinct ones stay distinct at any number of them.  Surrogates of
addresses, IBANs and names are hashes.  Collision checks keep all of them distinct: the distinct
entities of the corpus are hashed once; of those that share a surrogate one keeps it, the others,
any whose surrogate is the entity itself and any hashed one whose surrogate is an entity of the
corpus get the next one of their sequence, until none collide (surrogates grow longer with each
round, so rounds end).  Texts are told by a hash: those that hold an exception are marked in a
bitmap of fixed size; only texts that hit it are shuffled to get their numbers, all others are projected.

The key is a literal of the plan: logs that hold plans are as secret as the key.  Names are found
behind a title only, up to four parts; local parts of addresses up to 64 characters.

Edge cases: null text stays null; text without entities is unchanged; repeated rows are
replaced alike; the same key gives the same surrogates in every run over the same entities;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored
from .decontaminate import let

OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TITLES_MALE = ("Mister", "Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Г-н", "Κύριος")
TITLES_FEMALE = ("Mrs", "Miss", "Ms", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "Госпожа", "Г-жа", "Κυρία")
TITLES_NEUTRAL = ("Mx", "Dr", "Prof")
TITLES = TITLES_MALE + TITLES_FEMALE + TITLES_NEUTRAL
TITLE = "(?:" + "|".join(TITLES) + ")"
INITIAL = "[" + "".join(sorted({t[0] for t in TITLES})) + "]"
PART = r"\p{Lu}[\p{L}'’-]+"
NAME = rf"(?={INITIAL})(?<![\p{{L}}\p{{N}}]){TITLE}\.? {PART}(?: {PART}){{0,3}}"
#: An address starts in front of a run of letters and digits, or within a longer run than a local part can be.
EMAIL = r"(?:(?<![A-Za-z0-9])|(?<=[A-Za-z0-9._%+-]{64}))[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){0,8}(?<=\.[A-Za-z]{2,63})"
NUMBERS = (
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
    rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z.,-])(?:[3-6][0-9]{12,15}|[3-6][0-9]{3}(?:[ -][0-9]{4}){3}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9A-Za-z])",
)
WITHOUT_EMAIL = "(?=[A-Z0-9+(])(?:" + "|".join(f"(?:{p})" for p in NUMBERS) + f")|(?:{NAME})"
ENTITY = f"(?:{EMAIL})|{WITHOUT_EMAIL}"
#: A text without any of these holds no entity.
HINT = rf"[0-9@]|{TITLE}"
#: Bits of the largest bitmap of exceptions.
MOST_BITS = 20
#: Given names by gender and script, and syllables of family names by script.
GIVEN = {
    ("m", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karel Leo Martin Nils Oscar Paul Quentin Robert Simon Thomas".split(),
    ("f", "latin"): "Anna Berta Clara Diana Emma Flora Greta Helena Irma Julia Karin Laura Maria Nora Olga Paula Rosa Sofia Teresa Vera".split(),
    ("m", "cyrillic"): "Алексей Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур".split(),
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Инна Клара Лидия Мария Нина Ольга Полина Софья".split(),
    ("m", "greek"): "Αλέξης Γιώργος Δημήτρης Κώστας Λεωνίδας Μάρκος Νίκος Πέτρος".split(),
    ("f", "greek"): "Άννα Δάφνη Ελένη Ζωή Ιωάννα Κατερίνα Μαρία Σοφία".split(),
}
SYLLABLES = {
    "latin": "ba de fo gi hu ka le mo ni pu ra se to vi wu za".split(),
    "cyrillic": "ба де фо ги ху ка ле мо ни пу ра се то ви зу ча".split(),
    "greek": "βα δε φο γι χυ κα λε μο νι που ρα σε το ξι ζα θη".split(),
}


def array_of(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def kind_of(m: Column) -> Column:
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(~m.rlike("[0-9]"), "name")
        .when((F.length(digits_of(m)) >= 13) & m.rlike("^[0-9]"), "card")
        .otherwise("phone")
    )


def norm_of(m: Column, kind: Column) -> Column:
    """What all spellings of an entity have in common; for names with gender and script in front."""
    title = F.regexp_extract(m, rf"^({TITLE})\.? ", 1)
    gender = F.when(title.isin(*TITLES_MALE), "m").when(title.isin(*TITLES_FEMALE), "f").otherwise("n")
    script = F.when(m.rlike(r"\p{IsCyrillic}"), "cyrillic").when(m.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    bare = F.lower(F.regexp_replace(m, rf"^{TITLE}\.? ", ""))
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "name", F.concat_ws("|", gender, script, bare))
        .otherwise(digits_of(m))
    )


def luhn_sum(digits: Column) -> Column:
    """Sum of a digit string whose last digit is the check digit; each second digit before it counts double."""
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(
        F.transform(
            F.split(F.reverse(digits), ""),
            lambda c, i: F.when(i % 2 == 1, doubled(F.coalesce(c.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))),
        ),
        F.lit(0),
        lambda acc, x: acc + x,
    )


def spelled(template: Column, stream: Column) -> Column:
    """Each digit and ASCII letter of ``template`` replaced by one of its class, as ``stream`` (hex) says."""
    digits, letters = F.translate(stream, "abcdef", "037159"), F.translate(stream, "0123456789abcdef", "qwrtpsdfgbnmkzcv")
    one = lambda s, i: F.substring(s, i % 128 + 1, F.lit(1))
    return F.array_join(
        F.transform(
            F.split(template, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), one(digits, i)).when(c.rlike("[a-z]"), one(letters, i)).when(c.rlike("[A-Z]"), F.upper(one(letters, i))).otherwise(c),
        ),
        "",
    )


def permuted(value: Column, size: Column, base: int, tweak: Column, key: str, rounds: int = 6) -> Column:
    """Keyed permutation of the numbers of ``size`` digits to ``base``: a Feistel network of two halves.

    ``value``: array of the two halves as numbers, the left one of floor(size / 2) digits.  Returns the same."""
    left = F.floor(size / 2)
    spans = [F.pow(F.lit(float(base)), x).cast("long") for x in (left, size - left)]

    def hashed(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("\u001f", F.lit(f"{key}#p"), tweak, size.cast("string"), i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    def turn(s: Column, i: Column) -> Column:
        a, b = F.get(s, F.lit(0)), F.get(s, F.lit(1))
        return F.when(i % 2 == 0, F.array(F.pmod(a + hashed(i, b), spans[0]), b)).otherwise(F.array(a, F.pmod(b + hashed(i, a), spans[1])))

    return F.aggregate(F.array(*[F.lit(i) for i in range(rounds)]), value, turn)


def permuted_digits(digits: Column, tweak: Column, key: str) -> Column:
    """The same for a string of 2 to 30 digits."""
    size = F.length(digits)
    left = F.floor(size / 2).cast("int")
    halves = F.array(F.substring(digits, F.lit(1), left).try_cast("long"), F.substring(digits, left + 1, size).try_cast("long"))
    return let(
        permuted(halves, size, 10, tweak, key),
        lambda s: F.concat(F.lpad(F.get(s, F.lit(0)).cast("string"), left, F.lit("0")), F.lpad(F.get(s, F.lit(1)).cast("string"), size - left, F.lit("0"))),
    )


def permuted_ip(ip: Column, tweak: Column, key: str) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    of = lambda i: F.get(octets, F.lit(i))
    halves = F.array(of(0) * 256 + of(1), of(2) * 256 + of(3))
    return let(
        permuted(halves, F.lit(4), 256, tweak, key),
        lambda s: F.concat_ws(".", *[x.cast("string") for i in (0, 1) for x in (F.floor(F.get(s, F.lit(i)) / 256), F.get(s, F.lit(i)) % 256)]),
    )


def iban_check(iban: Column) -> Column:
    """98 less the remainder by 97 of the account and country: the number that the check digits should be."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 2), F.lit("00"))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return 98 - rest


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The normalised surrogate: number ``attempt`` of the entity's sequence."""

    def stream(of: Column) -> Column:
        return F.concat(*[F.sha2(F.concat_ws("\u001f", F.lit(f"{key}#{n}"), kind, of, attempt.cast("string")), 256) for n in (0, 1)])

    def nibble(s: Column, i: int, n: int) -> Column:
        return F.conv(F.substring(s, i, n), 16, 10).cast("int")

    tweak = F.concat_ws("#", kind, attempt.cast("string"))
    last = F.length(norm)
    first, rest = F.substring(norm, 1, 1), F.substring(norm, F.lit(2), last)
    luhn = lambda body: (F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10

    def card() -> Column:
        """First digit and the distance of the last one from the right check digit stay."""
        old = F.substring(norm, F.lit(1), last - 1)
        off = F.substring(norm, last, F.lit(1)).try_cast("int") - luhn(old)
        body = F.concat(first, permuted_digits(F.substring(norm, F.lit(2), last - 2), F.concat_ws("#", tweak, first), key))
        return let(body, lambda b: F.concat(b, F.pmod(luhn(b) + off, F.lit(10)).cast("string")))

    def iban(s: Column) -> Column:
        """Country, layout and the distance of the check digits from the right ones stay."""
        off = F.substring(norm, 3, 2).try_cast("int") - iban_check(norm)
        bare = F.concat(F.substring(norm, 1, 4), spelled(F.substring(norm, F.lit(5), last), s))
        checked = lambda b: F.lpad((F.pmod(iban_check(b) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0")
        return let(bare, lambda b: F.concat(F.substring(norm, 1, 2), checked(b), F.substring(b, F.lit(5), last)))

    def email(s: Column) -> Column:
        """The local part by the whole address, the domain by the domain alone, under a reserved end."""
        local, domain = F.substring_index(norm, "@", 1), F.substring_index(norm, "@", -1)
        labels = F.when(domain.rlike(r"\.example\.[a-z]+$"), F.regexp_replace(domain, r"\.example\.[a-z]+$", "")).otherwise(F.regexp_replace(domain, r"\.[a-z]+$", ""))
        longer = F.when(attempt > 0, F.concat(F.lit("."), F.translate(F.substring(s, 100, 8), "0123456789", "ghijklmnop"))).otherwise("")
        return F.concat(spelled(local, s), longer, F.lit("@"), spelled(labels, F.sha2(F.concat_ws("\u001f", F.lit(key), domain), 512)), F.lit(".example"))

    def name(s: Column) -> Column:
        """Given name of the gender and script, and a family name of five syllables and one more for each attempt."""
        parts, out = F.split(norm, r"\|"), None
        for script, syllables in SYLLABLES.items():
            made = array_of(syllables)
            count = F.lit(5) + attempt
            family = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(made, F.conv(F.substring(s, i % 120 + 5, F.lit(1)), 16, 10).cast("int"))), ""))
            for gender in "mfn":
                given = GIVEN["m", script] + GIVEN["f", script] if gender == "n" else GIVEN[gender, script]
                full = F.when(F.contains(parts[2], F.lit(" ")), F.concat_ws(" ", F.get(array_of(given), nibble(s, 1, 4) % len(given)), family)).otherwise(family)
                one, test = F.concat_ws("|", F.lit(gender), F.lit(script), full), (parts[0] == gender) & (parts[1] == script)
                out = F.when(test, one) if out is None else out.when(test, one)
        return out

    return (
        F.when(kind == "phone", F.concat(first, permuted_digits(rest, F.concat_ws("#", tweak, first), key)))
        .when(kind == "ssn", permuted_digits(norm, tweak, key))
        .when(kind == "card", card())
        .when(kind == "ip", permuted_ip(norm, tweak, key))
        .otherwise(let(stream(norm), lambda s: F.when(kind == "email", email(s)).when(kind == "iban", iban(s)).otherwise(name(s))))
    )


def rendered(m: Column, kind: Column, s: Column) -> Column:
    """The surrogate in the layout of the match."""
    mark = "[0-9]"
    laid_out = lambda mark, other: F.array_join(
        F.transform(
            F.split(m, ""),
            lambda c, i: F.when(
                c.rlike(mark), F.substring(s, F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), other, "")), F.lit(1))
            ).otherwise(c),
        ),
        "",
    )
    title = F.regexp_extract(m, rf"^{TITLE}\.? ", 0)
    return (
        F.when(kind == "email", F.when(F.upper(m) == m, F.upper(s)).otherwise(s))
        .when(kind == "ip", s)
        .when(kind == "iban", laid_out("[0-9A-Z]", "[^0-9A-Z]"))
        .when(kind == "name", F.concat(title, F.split(s, r"\|")[2]))
        .otherwise(laid_out(mark, "[^0-9]"))
    )


def by_pattern(text: Column, use) -> Column:
    """``use`` of the pattern of entities; texts without an at sign are spared that of addresses."""
    return F.when(F.contains(text, F.lit("@")), use(ENTITY)).otherwise(use(WITHOUT_EMAIL))


def matches(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.rlike(HINT), by_pattern(text, lambda p: F.regexp_extract_all(text, F.lit(p), 0))).otherwise(none)


def mark_of(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("h"), F.length(text).alias("l"))


def found_in(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(mark, m): texts with entities, by hash and length, and their matches in order."""
    text = F.col(f"`{text_col}`")
    return df.select(mark_of(text).alias("mark"), matches(text).alias("m")).filter(F.size("m") > 0)


def entities(found: DataFrame) -> DataFrame:
    """Distinct (kind, norm) of ``found_in``."""
    each = found.select(F.explode("m").alias("m")).withColumn("kind", kind_of(F.col("m")))
    return each.select("kind", norm_of(F.col("m"), F.col("kind")).alias("norm")).distinct()


def exceptions(known: DataFrame, key: str, rounds: int = 60) -> DataFrame | None:
    """(kind, norm, attempt) of the entities whose first surrogate collides, with the number of the one they get; None
    without any.

    Each round settles the entities that do not collide; only the rest go on."""
    now = known.withColumn("attempt", F.lit(0))
    settled = None
    for _ in range(rounds):
        made = stored(now.withColumn("s", surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), key)))
        every = made if settled is None else made.unionByName(settled)
        winner = every.groupBy("kind", "s").agg(F.min(F.struct("attempt", "norm")).alias("w"), F.count("*").alias("n"))
        clash = winner.filter("n > 1").select("kind", "s", F.col("w.norm").alias("keeps"))
        # Numbers are permuted: a surrogate that is another's number is no clash, as that one is replaced as well.
        real = known.filter(F.col("kind").isin("email", "iban", "name")).select("kind", F.col("norm").alias("s"), F.lit(None).cast("string").alias("keeps"))
        lost = made.join(clash.unionByName(real), ["kind", "s"]).filter(~F.col("norm").eqNullSafe(F.col("keeps"))).select("kind", "norm")
        lost = stored(lost.unionByName(made.filter("s = norm").select("kind", "norm")).distinct())
        if lost.isEmpty():
            return None if settled is None else stored(every.filter("attempt > 0").select("kind", "norm", "attempt"))
        kept = made.join(lost, ["kind", "norm"], "left_anti")
        settled = stored(kept if settled is None else kept.unionByName(settled))
        now = stored(made.join(lost, ["kind", "norm"], "left_semi").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
    raise RuntimeError("surrogates still collide")


def among(hashes: DataFrame):
    """A test for the numbers of the column ``h``: never wrong on one of them, rarely right on another while they are few."""
    n = hashes.count()
    bits = 10
    while (1 << bits) < 64 * n and bits < MOST_BITS:
        bits += 1
    slot = lambda h: h.bitwiseAND(F.lit((1 << bits) - 1))
    by = hashes.select(slot(F.col("h")).alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("at"))
    rows = by.agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("word")).collect()  # at most 2 ** (MOST_BITS - 6)
    table = [0] * (1 << (bits - 6))
    for r in rows:
        table[r["at"]] = r["word"]
    words = F.from_json(F.lit(str(table)), "array<bigint>")
    return lambda h: F.getbit(F.get(words, F.floor(slot(h) / 64).cast("int")), (slot(h) % 64).cast("int")) == 1


def replaced(text: Column, found: Column, attempts: Column | None, key: str) -> Column:
    """``text`` with each match replaced; ``attempts`` maps positions of matches to their number."""

    def one(m: Column, i: Column) -> Column:
        attempt = F.lit(0) if attempts is None else F.coalesce(F.try_element_at(attempts, i), F.lit(0))
        return let(kind_of(m), lambda k: let(surrogate(k, norm_of(m, k), attempt, key), lambda s: rendered(m, k, s)))

    gaps = by_pattern(text, lambda p: F.split(text, p, -1))
    pieces = F.zip_with(gaps, F.transform(found, one), lambda gap, s: F.concat(gap, F.coalesce(s, F.lit(""))))
    return F.when(F.size(found) > 0, F.array_join(pieces, "")).otherwise(text)


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", known: DataFrame | None = None, count_col: str = "_found") -> DataFrame:
    """``df``, all columns, with the entities of the text replaced; ``count_col`` holds the number of them.

    ``known``: distinct entities of a larger corpus that surrogates must stay distinct over."""
    if count_col in df.columns:
        raise ValueError(f"{count_col} is a column of the input; name another count_col")
    text = F.col(f"`{text_col}`")
    found = stored(found_in(df, text_col))
    own = stored(known if known is not None else entities(found))
    odd = exceptions(own, key)
    discard(own)
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), text.alias("_text"))

    def clean(rows: DataFrame, attempts: Column | None) -> DataFrame:
        made = rows.withColumn("_m", matches(F.col("_text")))
        return made.select("_row", replaced(F.col("_text"), F.col("_m"), attempts, key).alias("_clean"), F.size("_m").alias("_n"))

    if odd is None:
        made = clean(whole, None)
        discard(found)
    else:
        each = found.select("mark", F.posexplode("m").alias("i", "m")).withColumn("kind", kind_of(F.col("m")))
        each = each.select("mark", "i", "kind", norm_of(F.col("m"), F.col("kind")).alias("norm")).distinct()
        placed = each.join(odd, ["kind", "norm"]).groupBy("mark").agg(F.map_from_entries(F.collect_set(F.struct("i", "attempt"))).alias("_attempts"))
        placed = stored(placed)
        discard(found)
        asks = F.coalesce(among(placed.select("mark.h"))(F.xxhash64("_text")), F.lit(False))
        asking = whole.filter(asks).withColumn("mark", mark_of(F.col("_text"))).join(placed, "mark", "left")
        made = clean(whole.filter(~asks), None).unionByName(clean(asking, F.col("_attempts")))
    return made.select(*[F.col("_clean").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in df.columns], F.col("_n").alias(count_col))
