"""Personal data replaced by keyed surrogates of the same type and format.

Mentions are found by one alternation of patterns: e-mail addresses, telephone,
card, account (IBAN) and social security numbers, IPv4 and IPv6 addresses, secrets and
access keys, names after a form of address, names that begin with a common given name,
and Chinese names before a form of address. Numbers of 13 to 19 digits without gaps are
cards only if they pass the Luhn test. Each mention is brought to a canonical value
(digits only, lower case, no title), and the distinct values get surrogates from a keyed
hash; the key is a secret of the caller:

- equal values get equal surrogates everywhere (coreference), also where their
  format differs: a number is written into the digits of each mention, a
  surname stands for the same person with and without the given name;
- a name that a form of address has shown is replaced in the rest of its document too,
  where it stands as a whole word in the same case;
- digits become digits, letters letters of their case, hex stays hex, cards keep
  their first digit and whether they pass the Luhn test, addresses go to reserved
  ranges and domains, names keep gender (by form of address or given name) and script;
- surrogates are checked for collisions, with each other and with real values,
  and drawn again until there are none (distinctness).

DataFrame functions only; no Python runs on the executors. What is shuffled are
mentions, not texts without mentions.

Not detected: names with neither a form of address nor a common given name, and later
mentions of Chinese names without one. A digest in hexadecimal can't be told from a key
and is replaced. Check digits of IBANs aren't kept valid.

Defined cases: a null text stays null; texts without mentions, empty ones too, stay as
they are; very long texts are read whole; equal rows get equal results, as mentions go
by the text's hash and not by the id; where mentions could overlap the earlier and then
the first pattern wins; other columns are kept, whatever their names; the empty table
gives an empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiquarry.llm.common import small, staged, two_hashes

MAX_ROUNDS = 30
FEMALE = "Mrs|Ms|Miss|Madam|Frau|Madame|Mme|Mlle|Señora|Señorita|госпожа|г-жа|Κυρία|κυρία|MRS|MS|MISS|FRAU|MADAME"
MALE = "Mr|Herr|Herrn|Monsieur|Señor|господин|г-н|Κύριος|κύριος|MR|HERR|MONSIEUR"
NEUTRAL = "Dr|Prof|Professor|DR|PROF"
#: Common given names, which make a name of the capitalised word after them.
WOMEN = "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Emily|Michelle|Laura|Anna|Maria|Julia|Claudia|Sabine|Petra|Ursula|Monika|Camille|Chantal|Sophie|Nathalie|Carmen|Pilar|Lucía|Ana|Olga|Irina|Ольга|Ирина|Анна|Мария"
MEN = "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Steven|Paul|Andrew|Peter|George|Hans|Klaus|Stefan|Wolfgang|Jürgen|Jean|Pierre|François|Luc|José|Juan|Carlos|Miguel|Javier|Ivan|Sergei|Иван|Сергей|Николай|Георгий"
#: Common Chinese family names and forms of address after a name.
FAMILIES, AFTER = "王李张刘陈杨黄赵周吴徐孙胡朱高林何郭马罗", "先生|女士|小姐|老师"
_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"


def _one_of(words: str, latin: bool) -> str:
    """An alternation of the words, Latin or other, grouped by first letter: a look at one character rules most out."""
    groups: dict[str, list[str]] = {}
    for word in words.split("|"):
        if word[0].isascii() == latin:
            groups.setdefault(word[0], []).append(word[1:])
    return "(?:" + "|".join(f"{first}(?:{'|'.join(sorted(rest, key=len, reverse=True))})" for first, rest in sorted(groups.items())) + ")"


TITLES, GIVEN = "|".join((FEMALE, MALE, NEUTRAL)), f"{WOMEN}|{MEN}"
_AFTER_TITLE, _AFTER_GIVEN = rf"\.?[ \u00A0]{_NAME}(?:[ \u00A0]{_NAME})?", rf"[ \u00A0]{_NAME}"
PERSON = "|".join(rf"(?={'[A-Z]' if latin else '[^\\x00-\\x7F]'})(?<![\p{{L}}\p{{N}}])(?:{_one_of(TITLES, latin)}{_AFTER_TITLE}|{_one_of(GIVEN, latin)}{_AFTER_GIVEN})" for latin in (True, False))
HAN = rf"[{FAMILIES}]\p{{IsHan}}{{0,2}}(?={AFTER})"
EMAIL = r"(?<![^\s(){}<>\[\],;:=\"'|/])(?![@\s])[^\s@(){}<>\[\],;:=\"'|/]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?=[PpTtSsAa])(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|auth)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_+/=-]{8,}"
ACCESS = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp|gho|sk|pk)_[A-Za-z0-9_]{16,}\b|\b(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{32,128}\b"
IP = r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
IP6 = r"(?=[0-9A-Fa-f])(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:])"
IBAN = r"(?=[A-Z])\b[A-Z]{2}\d{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?\b"
SSN = r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?=\d)(?:(?<![\d-])(?:\d{4}[ -]){3}\d{1,7}(?![\d-])|(?<![\d-])\d{4}[ -]\d{6}[ -]\d{5}(?![\d-])|(?<!\d)\d{13,19}(?!\d))"
PHONE = r"(?=[+(\d])(?:(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])|(?<![\d.,-])0\d{2,4}[ /-]\d{5,8}(?![\d-]))"
#: What can't begin within a word is tried at its start only, numbers only at what begins one.
ANY = rf"(?<![A-Za-z])(?:{'|'.join((EMAIL, SECRET, ACCESS, IBAN, IP6, PERSON))})|(?=[0-9+(])(?:{'|'.join((IP, SSN, CARD, PHONE))})|{HAN}"
#: A text without any of these holds no mention: a cheap test before the patterns are tried.
HINT = rf"(?=[A-Z]){_one_of(f'{TITLES}|{GIVEN}', True)}\.?[ \u00A0]\p{{Lu}}"
SECRET_HINT = r"(?i:password|passwd|pwd|token|secret|key|auth)\s{0,3}[=:]"


def hinted(text: Column) -> Column:
    """Whether a text can hold a mention."""
    others = reduce(lambda a, b: a | b, (text.contains(x) for x in f"{TITLES}|{GIVEN}|{AFTER}".split("|") if not x[0].isascii()))
    return text.rlike("[0-9@]") | text.rlike(HINT) | ((F.length(text) != F.octet_length(text)) & others) | ((text.contains("=") | text.contains(":")) & text.rlike(SECRET_HINT))

SYLLABLES = {
    "latin": ("ba be bo da de di do fa fe ga go ha he ka ke ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi wa we za zo".split(), "o", "a", "e", "er"),
    "cyrillic": ("ба бе бо ва ве ви га го да де ди до за зе ка ке ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си со та те ти то фе ха".split(), "й", "я", "а", "ов"),
    "greek": ("βα βε γα γο δα δε δι ζα ζω θα θε κα κε κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι σο τα τε τι το φα φε χα χο".split(), "ος", "α", "ω", "ιδης"),
    "han": ("安 白 昌 成 德 东 方 芳 飞 丰 高 光 广 贵 国 海 和 红 华 嘉 建 江 金 景 静 君 开 兰 乐 丽 林 龙 美 明 宁 平 清 庆 荣 山 世 思 天 文 祥 新 永 云".split(), "强", "娟", "青", ""),
}


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").when(value.rlike(r"\p{IsGreek}"), "greek").when(value.rlike(r"\p{IsHan}"), "han").otherwise("latin")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _part(kind: Column | str, prefix: Column | str, value: Column, shown: Column) -> Column:
    k = F.lit(kind) if isinstance(kind, str) else kind
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.struct(k.alias("kind"), p.alias("prefix"), value.alias("value"), shown.alias("shown"))


def parts(m: Column) -> Column:
    """The parts (kind, prefix, canonical value, shown) of a mention."""
    secret = rf"^({SECRET.rsplit('[A-Za-z0-9_+/=-]', 1)[0]})(.*)$"
    title = rf"^((?:{FEMALE}|{MALE}|{NEUTRAL})\.?[ \u00A0])"
    names = F.regexp_replace(m, title, "")
    first = F.regexp_extract(names, r"^([^ \u00A0]+)[ \u00A0]", 1)
    last = F.regexp_extract(names, r"([^ \u00A0]+)$", 1)
    gender = F.when(m.rlike(rf"^(?:{FEMALE})\.?[ \u00A0]"), "f").when(m.rlike(rf"^(?:{MALE})\.?[ \u00A0]"), "m").when(names.rlike(rf"^(?:{WOMEN})[ \u00A0]"), "f").when(names.rlike(rf"^(?:{MEN})[ \u00A0]"), "m").otherwise("n")
    surname = F.regexp_replace(F.lower(last), "(ов|ев|ин)а$", "$1")
    tail = F.when((gender == "f") & F.lower(last).rlike("(?:ов|ев|ин)а$"), "surname_a").otherwise("surname")
    given = _part(F.concat(F.lit("given_"), gender), F.regexp_extract(m, title, 1), F.lower(first), first)
    alone = _part(tail, F.regexp_extract(m, title, 1), surname, last)
    after = _part(tail, F.regexp_extract(names, r"([ \u00A0])[^ \u00A0]+$", 1), surname, last)
    digits = _digits(m)
    return (
        F.when(m.rlike(f"^{EMAIL}$"), F.array(_part("email", "", F.lower(m), m)))
        .when(m.rlike(secret), F.array(_part("secret", F.regexp_extract(m, secret, 1), F.regexp_extract(m, secret, 2), F.regexp_extract(m, secret, 2))))
        .when(m.rlike(f"^(?:{ACCESS})$"), F.array(_part("secret", "", m, m)))
        .when(m.rlike(f"^(?:{IBAN})$"), F.array(_part("iban", "", F.replace(m, F.lit(" "), F.lit("")), m)))
        .when(m.rlike(f"^(?:{IP})$"), F.array(_part("ip", "", m, m)))
        .when(m.rlike(f"^(?:{IP6})$"), F.array(_part("ip6", "", F.lower(m), m)))
        .when(m.rlike(f"^(?:{SSN})$"), F.array(_part("ssn", "", digits, m)))
        .when(m.rlike(r"^\p{IsHan}+$"), F.array(_part("han", "", m, m)))
        .when(m.rlike(r"^\d{13,19}$") & (luhn(digits) != 0), F.array(_part("plain", "", m, m)))
        .when(m.rlike(f"^(?:{CARD})$"), F.array(_part("card", "", digits, m)))
        .when(m.rlike(f"^(?:{PHONE})$"), F.array(_part("phone", "", F.right(digits, F.lit(10)), m)))
        .when(first != "", F.array(given, after))
        .otherwise(F.array(alone))
    )


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """Keyed hex digits, two for each character and 64 at least."""
    n = F.greatest(F.lit(1), F.ceil(F.length(value) / 32).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt, i), 256)), "")


def _byte(stream: Column, i: Column | int) -> Column:
    at = (i if isinstance(i, Column) else F.lit(i)) * 2 + 1
    return F.conv(F.substring(stream, at, F.lit(2)), 16, 10).cast("int")


def _pick(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(number, F.lit(len(alphabet))) + 1, F.lit(1))


def _alike(value: Column, stream: Column) -> Column:
    """The value with each character replaced by one of its class."""
    hexed = value.rlike("^[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        n = _byte(stream, i)
        lower = F.when(hexed, _pick("abcdef", n)).otherwise(_pick("abcdefghijklmnopqrstuvwxyz", n))
        return F.when(c.rlike("[0-9]"), _pick("0123456789", n)).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)

    prefix = F.regexp_extract(value, "^(AKIA|ASIA|ghp_|gho_|sk_|pk_)", 1)
    body = F.expr("substring(value, length(regexp_extract(value, '^(AKIA|ASIA|ghp_|gho_|sk_|pk_)', 1)) + 1)")
    return F.concat(prefix, F.array_join(F.transform(F.split(body, ""), one), ""))


def luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10; null for the empty string."""
    back = F.split(F.reverse(digits), "")
    return F.aggregate(F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1))), F.lit(0), lambda a, x: a + x) % 10


def _name(kind: str, stream: Column, attempt: Column) -> Column:
    """A name of two syllables or more in the script of ``value``; later attempts are longer."""
    out = F.lit(None).cast("string")
    for script, (syllables, male, female, neutral, surname) in SYLLABLES.items():
        table = F.array(*map(F.lit, syllables))
        end = {"given_m": male, "given_f": female, "given_n": neutral}.get(kind, surname)
        more = 3 if kind == "surname" else 2
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(more - 1) + F.least(attempt, F.lit(8))), lambda i: F.element_at(table, F.pmod(_byte(stream, i * 2) * 256 + _byte(stream, i * 2 + 1), F.lit(len(syllables))) + 1)), "")
        out = F.when(F.col("script") == script, F.concat(body, F.lit(end))).otherwise(out)
    return out


def drawn(key: str) -> Column:
    """The surrogate of (kind, value, script) at ``attempt``."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    s = F.col("stream")
    local = F.regexp_extract(value, "^([^@]+)@", 1)
    domain = F.regexp_extract(value, "@(.*)$", 1)
    host = F.concat(F.lit("m"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256), 1, 10), F.lit(".example.org"))
    email = F.concat(F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(c.rlike("[0-9]"), _pick("0123456789", _byte(s, i))).when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", _byte(s, i))).otherwise(c)), ""), F.when(attempt > 3, F.concat(F.lit("."), attempt.cast("string"))).otherwise(""), F.lit("@"), host)
    private = value.rlike(r"^(?:10\.|192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.)")
    ip = F.concat_ws(".", F.when(private, F.lit(10)).otherwise(240 + F.pmod(_byte(s, 0), F.lit(15))).cast("string"), *(_byte(s, i).cast("string") for i in (1, 2, 3)))
    numbers = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when((i == 0) & (c != "0"), _pick("123456789", _byte(s, i))).otherwise(_pick("0123456789", _byte(s, i)))), "")
    head = F.concat(F.substring(value, 1, 1), F.expr("''"), F.array_join(F.transform(F.split(F.expr("substring(value, 2, length(value) - 2)"), ""), lambda c, i: _pick("0123456789", _byte(s, i))), ""))
    valid = F.pmod(F.lit(10) - luhn(F.concat(head, F.lit("0"))), F.lit(10))
    wrong = F.pmod(valid + 1 + F.pmod(_byte(s, 31), F.lit(8)), F.lit(10))
    card = F.concat(head, F.when(luhn(value) == 0, valid).otherwise(wrong).cast("string"))
    hexes = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c == ":", c).otherwise(_pick("0123456789abcdef", _byte(s, i)))), "")
    ip6 = F.concat(F.lit("fd"), F.expr("''"), F.substring(hexes, 3, 64))  # unique local addresses
    family = F.substring(F.lit(FAMILIES), F.pmod(_byte(s, 30), F.lit(len(FAMILIES))) + 1, F.lit(1))
    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", F.when(value.rlike("^[0-9a-f]{4}"), ip6).otherwise(hexes)).when(kind.isin("phone", "ssn"), numbers).when(kind == "card", card).when(kind == "secret", _alike(value, s)).when(kind == "iban", F.concat(F.substring(value, 1, 2), F.substring(_alike(value, s), 3, 64))).when(kind == "han", F.concat(family, _name("han", s, attempt)))
    for name in ("given_m", "given_f", "given_n", "surname"):
        out = out.when(kind == name, _name(name, s, attempt))
    return out


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, surrogate) of distinct (kind, value): no two alike, none a real value."""
    held = staged(values.select("kind", "value").distinct().withColumn("script", _script(F.col("value"))).withColumn("attempt", F.lit(0)), "values")
    real = held.select("kind", F.col("value").alias("surrogate"))
    done = None
    for _ in range(MAX_ROUNDS):
        # the stream is staged with the draw, so its hashes are not computed again for each character
        fresh = held.withColumn("stream", _stream(key, F.col("kind"), F.col("value"), F.col("attempt")))
        fresh = staged(staged(fresh, "stream").withColumn("surrogate", drawn(key)).drop("stream"), "draw")
        taken = fresh.join(real, ["kind", "surrogate"], "left_semi").select("kind", "value")
        if done is not None:
            taken = taken.unionByName(fresh.join(done, ["kind", "surrogate"], "left_semi").select("kind", "value"))
        twice = fresh.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min("value").alias("first")).filter("n > 1")
        taken = taken.unionByName(fresh.join(twice, ["kind", "surrogate"]).filter("value <> first").select("kind", "value"))
        again = staged(taken.distinct(), "collisions")
        good = fresh.join(again, ["kind", "value"], "left_anti").select("kind", "surrogate", "value")
        done = staged(good if done is None else done.unionByName(good), "surrogates")
        if again.isEmpty():
            return done.select("kind", "value", "surrogate")
        held = staged(fresh.join(again, ["kind", "value"], "left_semi").select("kind", "value", "script", (F.col("attempt") + 1).alias("attempt")), "values")
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} rounds")


def _shown(kind: Column, shown: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: digits in its places, letters in its case."""
    sign = F.when(kind == "iban", "[0-9A-Z]").otherwise("[0-9]")
    n = F.length(F.regexp_replace(shown, F.concat(F.lit("[^"), F.substring(sign, 2, 8)), F.lit(""))) - F.length(surrogate)
    filled = F.aggregate(
        F.split(shown, ""),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.when(F.rlike(c, sign), F.struct(F.concat(a["out"], F.when(a["at"] < n, c).otherwise(F.substring(surrogate, a["at"] - n + 1, F.lit(1)))).alias("out"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["out"], c).alias("out"), a["at"].alias("at"))),
        lambda a: a["out"],
    )
    named = F.when(shown == F.upper(shown), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind.startswith("given") | kind.startswith("surname"), named).otherwise(surrogate)


def _word(name: Column) -> Column:
    """A pattern of the name as a whole word."""
    return F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), name, F.lit(r"\E(?![\p{L}\p{N}])"))


def replace(documents: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with surrogates in ``text``, and ``n_mentions``: how many were replaced.

    ``n_mentions`` replaces a column of that name. ``key`` is the secret that the surrogates hang on.
    """
    if not key:
        raise ValueError("surrogates need a secret key")
    body = F.col(f"`{text}`")
    h1, h2 = two_hashes(body)
    rows = documents.filter(hinted(body)).select(body.alias("text"), h1.alias("k1"), h2.alias("k2"))
    found = rows.select("k1", "k2", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("m")).filter(F.size("m") > 0)
    each = found.select("k1", "k2", F.posexplode("m").alias("place", "mention")).groupBy("k1", "k2", "place").agg(F.first("mention").alias("mention"))
    split = each.select("k1", "k2", "place", F.posexplode(parts(F.col("mention"))).alias("part", "p")).select("k1", "k2", "place", "part", "p.*")
    split = staged(split.withColumn("real", F.regexp_replace("kind", "^surname_a$", "surname")), "mentions")
    chosen = surrogates(split.filter("kind <> 'plain'").select(F.col("real").alias("kind"), "value"), key).withColumnRenamed("kind", "real")
    ending = F.when((F.col("kind") == "surname_a") & F.col("surrogate").rlike("(?:ов|ев|ин)$"), F.concat("surrogate", F.lit("а"))).otherwise(F.col("surrogate"))
    own = split.join(small(chosen)[0], ["real", "value"], "left").withColumn("own", F.when(F.col("kind") == "plain", F.col("shown")).otherwise(_shown(F.col("kind"), F.col("shown"), ending)))
    name = F.when(F.col("kind").startswith("given") | F.col("kind").startswith("surname"), F.struct("shown", "own"))
    shown = own.select("k1", "k2", "place", "part", F.concat("prefix", "own").alias("new"), (F.col("kind") != "plain").alias("counts"), name.alias("name"))
    whole = shown.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("place", "part", "new"))).alias("new"), F.sort_array(F.collect_set("name")).alias("names"), F.sum((F.col("counts") & (F.col("part") == 0)).cast("int")).alias("n"))
    names = F.filter("names", lambda n, i: (i == 0) | (F.get("names", i - 1)["shown"] != n["shown"]))
    whole = staged(whole.select("k1", "k2", "new", names.alias("names"), "n"), "replacements")
    at = documents.columns.index(text)
    keyed = documents.select(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns))).alias("row"), h1.alias("k1"), h2.alias("k2"))
    joined = keyed.join(small(whole)[0], ["k1", "k2"], "left")
    body = F.col(f"row.c{at}")
    renamed = lambda piece: F.aggregate("names", piece, lambda a, n: F.regexp_replace(a, _word(n["shown"]), n["own"]))
    placed = lambda i: F.array_join(F.transform(F.filter("new", lambda n: n["place"] == i - 1), lambda n: n["new"]), "")
    between = F.transform(F.split(body, ANY), lambda s, i: F.concat(F.when(i == 0, F.lit("")).otherwise(placed(i)), renamed(s)))
    out = F.when(F.col("new").isNull(), body).otherwise(F.array_join(between, ""))
    bare = F.when(F.size("names") > 0, F.aggregate(F.split(body, ANY), F.lit(0), lambda c, s: c + F.aggregate("names", F.lit(0), lambda a, n: a + F.regexp_count(s, _word(n["shown"])))))
    count = F.when(F.col("new").isNull(), 0).otherwise(F.col("n") + F.coalesce(bare, F.lit(0))).cast("int")
    done = joined.select("row", out.alias("out"), count.alias("n"))  # before the columns get their own names, which could be those used here
    return done.select(*((F.col("out") if i == at else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(documents.columns) if c != "n_mentions"), F.col("n").alias("n_mentions"))
