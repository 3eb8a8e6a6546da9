"""Surrogates for personal data, in DataFrame operations only.

Entities (mail addresses, phone numbers, IPv4 addresses, card and account numbers, secrets, names) are found by one
pattern and brought to a normal form, so that every spelling of an entity is one entity. Numbers of a card's length
count as cards only if their check digit is right. A name is two entities, its given and its family part, so that
"Mr Smith", "John Smith" and a later "Smith" of the same text stay one family. Each distinct entity gets
a surrogate keyed by a secret, its kind and its normal form: digits stay digits and letters stay letters of the
same case and script, valid card numbers stay valid, octets stay octets, mail addresses keep their top-level domain
and given names keep their gender. Surrogates that meet another surrogate of the kind, or a real entity, are drawn
again until all are distinct. The surrogate is then written in the layout of each mention.

Only distinct entities and the mention lists of texts that have any are shuffled; texts without mentions pass by.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, table_of

# Alphabets by script and case, for letters that are replaced within their script.
ALPHABETS = {
    "0-9": "0123456789",
    "a-z": "abcdefghijklmnopqrstuvwxyz",
    "A-Z": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "à-öø-ÿ": "àáâäçèéêëíîïñóôöùúûü",
    "À-ÖØ-Þ": "ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ",
    "а-яё": "абвгдежзиклмнопрстуфхцчшэюя",
    "А-ЯЁ": "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ",
    "α-ω": "αβγδεζηθικλμνξοπρστυφχψω",
    "Α-Ω": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
    "א-ת": "אבגדהוזחטילמנסעפצקרשת",
    "ء-ي": "بتثجحدذرزسشصطعفقكلمنهوي",
    "가-힣": "가나다라마바사아자차카타파하고노도로모보",
    "一-鿿": "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗",
}
#: Draws that keep every character's class; later ones lengthen the surrogate with the attempt, so that a free one is always found.
KEEP_DRAWS = 4
_FREE = "abcdefghijklmnopqrstuvwxyz0123456789"
# Given names by script and gender.
GIVEN_NAMES = {
    ("latin", "f"): (
        "Anna Maria Emma Julia Sarah Laura Claire Sophie Elena Lucia Alice Helen Marta Nora Ines Clara Carol Mary Linda Susan Karen Lisa Nancy Emily Olivia Amy Rachel Jane Ruth "
        "Katharina Sabine Monika Petra Ursula Greta Camille Chloé Amélie Margaux Carmen Pilar Rosa Fatima Aisha Leila Yasmin Priya Anjali Mei Yuki"
    ).split(),
    ("latin", "m"): (
        "John Paul Peter Thomas David Martin Lucas Henri Carlos Miguel Oscar Victor Anton Felix Hugo Simon James Robert Michael William Richard Joseph Charles Daniel Matthew Mark George Edward Brian Kevin "
        "Jürgen Hans Klaus Wolfgang Dieter Stefan Pierre Jean Luc André Olivier José Juan Luis Pedro Javier Tariq Ahmed Mohammed Omar Ali Hassan Raj Arjun Wei Hiroshi"
    ).split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Ирина Нина Вера Дарья Наталья Татьяна Светлана Юлия".split(),
    ("cyrillic", "m"): "Иван Пётр Павел Антон Игорь Олег Юрий Борис Сергей Дмитрий Алексей Андрей".split(),
}
# Forms of address, by gender; those that tell none.
TITLES = {"f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Lady|г-жа", "m": "Mr|Herr|Monsieur|Señor|Sr|Sir|Lord|г-н", "": "Dr|Prof|Professor"}
# Words before and after which two capitalised words are a person's name.
NAMED_BEFORE = "named|called|Dear|Hi|Hello|name is|I am|I'm|Name:|Contact:|Author:|Signed|Signed,|Sincerely,|Regards,|heiße|heißt|appelle|llamo|llama|зовут"
SPOKEN_AFTER = "said|says|wrote|writes|asked|told|replied|lives|lived|met|works|worked|was born|called|phoned|emailed|joined|signed|sagte|schrieb|wohnt|dit|habite|dijo|vive|сказал|сказала"

# possessive groups are matched in a loop, others by recursion: of a domain that ends in its top level any number of labels, of
# one that something else follows (a@b.com-x) as many as names have
EMAIL = r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:(?:\.[A-Za-z0-9-]++)++(?<=\.[A-Za-z]{2,63})|(?:\.[A-Za-z0-9-]+){0,20}\.[A-Za-z]{2,})"
IPV4 = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]?\d)"
CARD = r"(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
SECRET = r"(?<!\w)(?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{4,}+\"|'[^'\s]{4,}+'|[^\s\"']{4,}+)|(?<!\w)(?:AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9_-]{20,}+|sk-[A-Za-z0-9_-]{16,}+)(?!\w)"
_LISTED = "|".join(n for names in GIVEN_NAMES.values() for n in names)
_TITLED = "|".join(TITLES.values())
_PART = r"\p{Lu}[\p{L}'’-]*+"
_PAIR = r"\p{Lu}\p{Ll}[\p{L}'’-]*+ \p{Lu}\p{Ll}[\p{L}'’-]*+"
_JOINED = "and|und|et|y|и"
NAME = (
    rf"(?:{_TITLED})\.? {_PART}(?: {_PART})?(?!\w)|(?:{_LISTED}) {_PART}(?!\w)|(?<=(?<!\w)(?:{NAMED_BEFORE}) ){_PAIR}(?!\w)"
    rf"|{_PAIR}(?= (?:(?:{_JOINED}) {_PAIR} )?(?:{SPOKEN_AFTER})(?!\w))"
)
# every kind begins where a word does; what a place begins with tells which kinds are tried there
_ANY = rf"(?<!\w)(?:(?=[\d+(])(?:{IPV4}|{PHONE}|{CARD}|{SSN})|(?=[TtPpSsAagk])(?:{SECRET})|(?=[A-Z]{{2}}\d)(?:{IBAN})|(?=\p{{Lu}}|г)(?:{NAME})|{EMAIL})"

# what a text with any mention must hold somewhere: cheap, and few texts hold it
_MAYBE = rf"[\d@]|(?=[TtPpSsAaKkg])(?:(?i:token|passw|secret|key)|AKIA|gh[pousr]_|sk-)|(?=\p{{Lu}}|г)(?:(?:{_TITLED})\.? \p{{Lu}}|(?:{_LISTED}) \p{{Lu}}|\p{{Lu}}\p{{Ll}}[\p{{L}}'’-]*+ \p{{Lu}}\p{{Ll}})"


def _whole(mention: Column, pattern: str) -> Column:
    return mention.rlike(rf"^(?:{pattern})$")


def kind_of(mention: Column) -> Column:
    return (
        F.when(_whole(mention, SECRET), "secret").when(_whole(mention, EMAIL), "email").when(_whole(mention, IPV4), "ipv4").when(_whole(mention, SSN), "ssn")
        .when(_whole(mention, PHONE), "phone").when(_whole(mention, CARD), "card").when(_whole(mention, IBAN), "iban").otherwise("name")
    )


_SECRET_NAME = r"^((?i:token|password|passwd|secret|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)"


def secret_head(mention: Column) -> Column:
    """The part of a secret's mention that stays: its name, sign and opening quote."""
    return F.regexp_extract(mention, _SECRET_NAME, 1)


def normal_form(kind: Column, mention: Column) -> Column:
    """What all spellings of an entity have in common."""
    value = F.regexp_replace(F.regexp_replace(mention, _SECRET_NAME, ""), "[\"']$", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), F.regexp_replace(mention, r"\D", ""))
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "secret", value)
        .otherwise(mention)
    )


_TITLE = rf"^((?:{_TITLED})\.? )"
_POSSESSIVE = r"(['’]s)?$"


def parts_of(kind: Column, mention: Column) -> Column:
    """The entities of a mention in order: kind, norm, gender (given names) and the part of the mention that is written anew.

    A name's last word is its family part, a word before it the given one. A number of a card's length whose check
    digit is wrong is no entity: its kind is ``plain``.
    """
    words = F.split(F.regexp_replace(mention, _TITLE, ""), " ")
    bare = lambda w: F.regexp_replace(F.lower(w), r"['’]s$", "")
    gender = F.lit("")
    for (_, g), names in GIVEN_NAMES.items():
        gender = F.when(words[0].isin(names), g).otherwise(gender)
    for g in "fm":
        gender = F.when((gender == "") & mention.rlike(rf"^(?:{TITLES[g]})\.? "), g).otherwise(gender)
    one = lambda k, norm, sex, part: F.struct(k.alias("kind"), norm.alias("norm"), sex.alias("gender"), part.alias("part"))
    family = one(F.lit("family"), bare(F.element_at(words, -1)), F.lit(""), F.element_at(words, -1))
    given = one(F.lit("given"), bare(words[0]), gender, words[0])
    norm = normal_form(kind, mention)
    wrong = (kind == "card") & (F.when(kind == "card", _luhn_sum(norm, 0) % 10).otherwise(0) != 0)
    other = one(F.when(wrong, "plain").otherwise(kind), norm, F.lit(""), mention)
    return F.when(kind != "name", F.array(other)).when(F.size(words) > 1, F.array(given, family)).otherwise(F.array(family))


def _stream(seed: Column, n: Column) -> Column:
    """Eight hex digits for each of n places, from hashes of the seed and the place's block of 16: an array of blocks, so that a place is reached at once.

    The seed goes in by an array of one, so that it is made once and not for each block.
    """
    blocks = F.sequence(F.lit(0), F.floor(n / 16).cast("int"))
    return F.transform(F.array(seed), lambda s: F.transform(blocks, lambda k: F.sha2(F.concat_ws("\u0001", s, k.cast("string")), 512)))[0]


def _drawn(stream: Column, i: Column, n: int) -> Column:
    """A number below n for place i; no two places share digits."""
    return (F.conv(F.substring(F.element_at(stream, F.floor(i / 16).cast("int") + 1), (i % 16) * 8 + 1, F.lit(8)), 16, 10).cast("long") % n).cast("int")


def _cycle(secret: str) -> dict[str, str]:
    """A given name for each listed one, of its script and gender: the next in an order keyed by the secret, so no two share one and none keeps its own."""
    out = {}
    for names in GIVEN_NAMES.values():
        order = sorted((n.lower() for n in names), key=lambda n: hmac.new(secret.encode(), n.encode(), hashlib.sha256).digest())
        out |= dict(zip(order, [*order[1:], order[0]], strict=True))
    return out


def _like(c: Column, stream: Column, i: Column) -> Column:
    """Another character of the class of c."""
    out = None
    for span, letters in ALPHABETS.items():
        drawn = F.substring(F.lit(letters), _drawn(stream, i, len(letters)) + 1, F.lit(1))
        out = F.when(c.rlike(f"^[{span}]$"), drawn) if out is None else out.when(c.rlike(f"^[{span}]$"), drawn)
    return out.otherwise(c)


def _hex_like(c: Column, stream: Column, i: Column) -> Column:
    return F.when(c.rlike("^[0-9a-f]$"), F.substring(F.lit("0123456789abcdef"), _drawn(stream, i, 16) + 1, F.lit(1))).otherwise(c)


def _characters(s: Column, of) -> Column:
    chars = F.split(s, "")
    return F.array_join(F.transform(chars, of), "")


def _luhn_sum(digits: Column, from_right: int) -> Column:
    """Luhn sum of a string of digits whose last digit stands from_right places from the check digit."""
    parts = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when((i + from_right) % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + x)


def surrogate(secret: str) -> Column:
    """The surrogate's normal form, from kind, norm, gender, attempt and stream."""
    kind, norm, gender, attempt, stream = (F.col(c) for c in ("kind", "norm", "gender", "attempt", "stream"))
    like = lambda s: _characters(s, lambda c, i: _like(c, stream, i))
    grown = F.greatest(attempt - KEEP_DRAWS, F.lit(0))
    extra = F.sha2(F.array_join(stream, ""), 256)
    digits = F.substring(F.translate(extra, "abcdef", "012345"), F.lit(1), grown)
    letters = F.substring(F.translate(extra, "0123456789", "ghijklmnop"), F.lit(1), grown)
    places = F.sequence(F.lit(0), F.greatest(F.length(norm) + grown, F.lit(1)) - 1)
    free = F.array_join(F.transform(places, lambda i: F.substring(F.lit(_FREE), _drawn(stream, i, len(_FREE)) + 1, F.lit(1))), "")
    spelled = norm.rlike(f"[{''.join(ALPHABETS)}]")  # without such a character nothing is left to draw from
    top = F.regexp_extract(norm, r"(\.[A-Za-z]{2,})$", 1)
    body = F.expr("substring(norm, 1, length(norm) - length(regexp_extract(norm, '([.][A-Za-z]{2,})$', 1)))")
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_drawn(stream, i, 254) + 1).cast("string")), ".")
    card_body = F.concat(like(F.expr("substring(norm, 1, length(norm) - 1)")), digits)
    card = F.concat(card_body, ((10 - _luhn_sum(card_body, 1) % 10) % 10).cast("string"))
    code = F.expr("substring(norm, 1, greatest(length(norm) - 10, 0))")  # the country code stays
    phone = F.concat(code, like(F.expr("substring(norm, greatest(length(norm) - 10, 0) + 1)")), digits)
    account = F.concat(F.substring(norm, 1, 2), like(F.expr("substring(norm, 3)")), digits)
    next_name = F.create_map(*[F.lit(x) for pair in _cycle(secret).items() for x in pair])
    given = None
    for (script, g), names in GIVEN_NAMES.items():
        test = (gender == g) & (norm.rlike("[а-яё]") if script == "cyrillic" else ~norm.rlike("[а-яё]"))
        name = F.element_at(F.array(*[F.lit(n.lower()) for n in names]), _drawn(stream, F.lit(0), len(names)) + 1)
        given = F.when(test, name) if given is None else given.when(test, name)
    given = F.when(attempt == 0, F.try_element_at(next_name, norm)), given.otherwise(F.when(spelled, like(norm)).otherwise(free))
    return (
        F.when(kind == "email", F.concat(letters, like(body), top)).when(kind == "ipv4", octets).when(kind == "card", card).when(kind == "iban", account)
        .when(kind == "given", F.coalesce(given[0], F.concat(given[1], letters))).when(kind == "family", F.when(spelled, F.concat(like(norm), letters)).otherwise(free))
        .when(kind == "phone", phone).when(kind == "ssn", F.concat(like(norm), digits)).when((kind == "secret") & ((grown > 0) | ~spelled), free)
        .when((kind == "secret") & norm.rlike("^[0-9a-f]+$"), _characters(norm, lambda c, i: _hex_like(c, stream, i))).otherwise(like(norm))
    )


def rendered(kind: Column, mention: Column, new: Column) -> Column:
    """A surrogate in the layout of a mention: its separators, case and quotes; what is longer goes to the end."""
    letters = F.regexp_replace(mention, r"\D", "")
    rest = F.expr("substring(new, length(regexp_replace(part, '[^0-9]', '')) + 1)")
    spaced_rest = F.expr("substring(new, length(replace(part, ' ', '')) + 1)")
    in_layout = F.expr(
        "array_join(transform(split(part, ''), (c, i) -> case when c rlike '^[0-9]$' then "
        "substring(new, length(regexp_replace(substring(part, 1, i + 1), '[^0-9]', '')), 1) else c end), '')"
    )
    spaced = F.expr(
        "array_join(transform(split(part, ''), (c, i) -> case when c = ' ' then c else "
        "substring(new, length(replace(substring(part, 1, i + 1), ' ', '')), 1) end), '')"
    )
    capitals = (mention == F.upper(mention)) & mention.rlike(r"\p{Lu}.*\p{Lu}")
    cased = F.when(capitals, F.upper(new)).otherwise(new)
    owner = F.regexp_extract(mention, _POSSESSIVE, 1)
    head = secret_head(mention)
    tail = F.when(mention.rlike("[\"']$"), F.substring(mention, -1, 1)).otherwise("")
    return (
        F.when(kind.isin("phone", "card", "ssn") & (F.length(letters) <= F.length(new)), F.concat(in_layout, rest))
        .when(kind == "iban", F.concat(spaced, spaced_rest)).when(kind == "email", cased).when(kind == "secret", F.concat(head, new, tail))
        .when(kind.isin("given", "family"), F.concat(F.when(capitals, F.upper(new)).otherwise(F.initcap(new)), owner)).otherwise(new)
    )


def assigned(entities: DataFrame, secret: str) -> DataFrame:
    """entities: kind, norm, gender, distinct by kind and norm. Adds new, distinct by kind and no real entity's form.

    Given names alone may meet a real one: there are few, and the family part, which never does, goes with them.
    Of those that meet, the first in order of attempt and normal form stays; the others draw again, from the fifth time
    on longer forms each time. What has no character with another of its class becomes letters and digits at once.
    """
    current = entities.withColumn("attempt", F.lit(0))
    real = entities.where("kind <> 'given'").select("kind", F.col("norm").alias("new"), F.lit(True).alias("taken"))
    seed = F.sha2(F.concat_ws("\u0001", F.lit(secret), "kind", "norm", F.col("attempt").cast("string")), 512)
    length = F.length("norm") + F.greatest(F.col("attempt") - KEEP_DRAWS, F.lit(0)) + 4
    listed = F.col("norm").isin(sorted(_cycle(secret)))
    while True:
        drawn = table_of(current.withColumn("stream", _stream(seed, length)).withColumn("new", surrogate(secret)).drop("stream"), "surrogates")
        first = Window.partitionBy("kind", "new").orderBy(((F.col("kind") == "given") & listed).desc(), "attempt", "norm")
        checked = drawn.join(real, ["kind", "new"], "left").withColumn("again", (F.row_number().over(first) > 1) | F.col("taken").isNotNull())
        checked = table_of(checked, "surrogates")
        if checked.where("again").isEmpty():
            return checked.select("kind", "norm", "new")
        current = checked.select("kind", "norm", "gender", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def replace_entities(docs: DataFrame, secret: str, text_col: str = "text") -> DataFrame:
    """docs with its text replaced by one with surrogates, and n_replaced. secret is the key: who has it can redo the replacement.

    Names found: words after a form of address, a listed given name and the word after it, two capitalised words before
    or after the words listed above, and every other place of a family name in the text where it was found so.
    Defined cases: a null text stays null with 0 replaced; an empty text stays empty; repeated rows and ties get the
    same surrogates; rows keep their other columns (but for one named n_replaced, which is replaced); an empty table
    stays empty. An empty secret is refused.
    """
    if not secret:
        raise ValueError("surrogates need a secret")
    rows = docs.select(F.struct(*[F.col(_sql(c)) for c in docs.columns]).alias("row"), F.col(_sql(text_col)).alias("body"))
    found = F.expr(f"case when body rlike {_literal(_MAYBE)} then regexp_extract_all(body, {_literal(_ANY)}, 0) end")
    rows = rows.withColumn("mentions", F.coalesce(found, F.array().cast("array<string>")))
    kept = [c for c in docs.columns if c.lower() != "n_replaced"]

    def with_text(df: DataFrame, body: Column, n: Column) -> DataFrame:
        return df.select(*[body.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in kept], n.alias("n_replaced"))

    clean = with_text(rows.where(F.size("mentions") == 0), F.col("body"), F.lit(0))
    dirty = rows.where(F.size("mentions") > 0)
    # a text with names is searched once more, for its family names by themselves too
    names = F.filter("mentions", lambda m: m.rlike(rf"^(?:{NAME})$|^{_PAIR}$"))
    family = F.array_distinct(F.transform(names, lambda m: F.regexp_replace(F.regexp_extract(m, r"([^ ]+)$", 1), r"['’]s$", "")))
    pattern = F.when(F.size("families") > 0, F.concat(F.lit(_ANY + r"|(?<![\p{L}\p{N}_])(?:"), F.array_join("families", "|"), F.lit(r")(?:['’]s)?(?![\p{L}\p{N}_])"))).otherwise(F.lit(_ANY))
    dirty = dirty.withColumn("families", family).withColumn("pattern", pattern)
    again = F.when(F.size("families") > 0, F.expr("regexp_extract_all(body, pattern, 0)")).otherwise(F.col("mentions"))
    dirty = dirty.withColumn("mentions", again).withColumn("list", F.sha2(F.to_json("mentions"), 256))
    lists = table_of(dirty.groupBy("list").agg(F.first("mentions").alias("mentions")), "mention-lists")
    each = lists.select("list", F.posexplode("mentions").alias("place", "mention")).withColumn("whole", kind_of(F.col("mention")))
    each = table_of(each.select("list", "place", "mention", "whole", F.posexplode(parts_of(F.col("whole"), F.col("mention"))).alias("nth", "entity")).select("list", "place", "mention", "nth", "entity.*"), "mentions")
    entities = each.where("kind <> 'plain'").groupBy("kind", "norm").agg(F.max("gender").alias("gender"))
    known = table_of(assigned(table_of(entities, "entities"), secret), "known")
    title = F.when(F.col("kind").isin("given", "family") & (F.col("nth") == 0), F.regexp_extract("mention", _TITLE, 1)).otherwise("")
    blank = F.when(F.col("nth") > 0, " ").otherwise("")
    written = each.join(known, ["kind", "norm"], "left").withColumn("instead", F.when(F.col("kind") == "plain", F.col("mention")).otherwise(F.concat(title, blank, rendered(F.col("kind"), F.col("part"), F.col("new")))))
    whole = written.groupBy("list", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "instead"))), lambda x: x["instead"]), "").alias("instead"), F.max((F.col("kind") != "plain").cast("int")).alias("replaced"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("place", "instead"))), lambda x: x["instead"])
    instead = table_of(whole.groupBy("list").agg(in_order.alias("instead"), F.sum("replaced").cast("int").alias("n")), "replacements")
    joined = dirty.join(instead, "list").withColumn("gaps", F.expr("split(body, pattern, -1)"))
    pieces = F.transform("gaps", lambda gap, i: F.concat(gap, F.coalesce(F.try_element_at("instead", i + 1), F.lit(""))))
    return clean.unionByName(with_text(joined, F.array_join(pieces, ""), F.col("n")))


def session_secret(spark: SparkSession) -> str:
    """The session's key, spark.loomtext.surrogate.secret; where it names none, a random one for the rest of the session."""
    name = "spark.loomtext.surrogate.secret"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def _sql(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _literal(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def op1_surrogates(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return replace_entities(docs, session_secret(spark)).select("doc_id", "text", "n_replaced")


ORACLE_SQL: dict[str, str] = {}
QUERIES = {"op1_surrogates": op1_surrogates}
