"""Identity signals in item texts, with the text around them."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.shared import ship

# Forms of identifiers, as (kind, evidence, pattern); the first group, where there is one, is the value.
_SEP = r"[\s:：=@._\-－—–~～]"
_I = re.I
KEY_BLOCK = re.compile(r"-----BEGIN PGP PUBLIC KEY BLOCK-----(.*?)-----END PGP PUBLIC KEY BLOCK-----", re.I | re.S)
PATTERNS = [
    ("pgp_fingerprint", "pgp_fingerprint", re.compile(r"(?:pgp|fingerprint|指纹|公钥)[^\n\rA-Fa-f0-9]{0,24}([A-Fa-f0-9]{4}(?:[\s:.-]?[A-Fa-f0-9]{4}){9})", _I)),
    ("email", "plain_email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")),
    ("telegram", "telegram_cue", re.compile(
        rf"(?<![A-Za-z0-9])(?:(?:电报|纸飞机|飞机)(?:\s*(?:账号|号|联系))?{_SEP}{{0,12}}@?|(?:telegram|tg|tele)(?:\s*(?:id|account|acct|handle|账号|号|联系))?{_SEP}{{1,12}}@?)([A-Za-z][A-Za-z0-9_]{{4,31}})\b", _I)),
    ("telegram", "telegram_url", re.compile(r"(?:t\.me|telegram\.me)\s*/\s*([A-Za-z][A-Za-z0-9_]{4,31})\b", _I)),
    ("telegram", "telegram_at_handle_with_context", re.compile(r"(?<![A-Za-z0-9._%+-])@([A-Za-z][A-Za-z0-9_]{4,31})(?![A-Za-z0-9._%+-])")),
    ("wickr", "wickr_cue", re.compile(r"(?<![A-Za-z0-9])(?:wickr(?:\s*me|\s*id)?|威克)(?![A-Za-z0-9])[\s:：=@._-]{0,6}([A-Za-z0-9_.-]{3,32})\b", _I)),
    ("wechat", "wechat_cue", re.compile(rf"(?<![A-Za-z0-9])(?:微信|威信|weixin|wechat|vx|wx|v信|v[:：])(?:\s*(?:id|号|账号|联系))?{_SEP}{{0,10}}([A-Za-z][A-Za-z0-9_-]{{4,32}})\b", _I)),
    ("jabber", "jabber_cue", re.compile(r"(?<![A-Za-z0-9])(?:jabber|xmpp)(?![A-Za-z0-9])[\s:：=@._-]{0,6}([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24})", _I)),
    ("qq", "qq_cue", re.compile(rf"(?<![A-Za-z0-9])(?:qq|企鹅|扣扣|q\s*q?|q号)(?:\s*(?:id|号|账号|联系))?{_SEP}{{0,10}}([1-9]\d{{4,11}})", _I)),
    ("phone", "phone_cue", re.compile(r"(?:whatsapp|phone|tel|电话|手机|联系|联系方式)[^0-9A-Za-z+]{0,8}([+]?\d[\d\-\s()]{7,}\d)", _I)),
    ("bat", "bat_cue", re.compile(rf"(?<![A-Za-z0-9])(?:(?:蝙蝠)(?:\s*(?:id|账号|号))?{_SEP}{{0,8}}|(?:bat)(?:\s*(?:id|账号|号))?{_SEP}{{1,8}})([A-Za-z0-9][A-Za-z0-9_.-]{{4,32}})\b", _I)),
    ("crypto_wallet", "crypto_wallet", re.compile(r"\b(bc1[ac-hj-np-z02-9]{11,71}|[13][a-km-zA-HJ-NP-Z1-9]{25,34}|0x[a-fA-F0-9]{40}|T[A-HJ-NP-Za-km-z1-9]{33})\b")),
    ("external_url", "external_url", re.compile(r"\b((?:https?://|www\.)[^\s\]）)>,，。；;'\"`]{6,180})", _I)),
    ("external_url", "bare_domain", re.compile(r"(?<![@\w.-])([a-z0-9][a-z0-9\-]{1,40}\.(?:com|net|org|vip|cn|cc|top|xyz|onion)(?:/[^\s\]）)>,，。；;'\"`]{1,120})?)", _I)),
]
# What says that a text speaks of the seller's own contacts, of goods that are data, of payments.
CUES = re.compile(
    r"(contact|message|dm\b|reach|support|telegram|(?<![A-Za-z0-9])tg(?![A-Za-z0-9])|电报|飞机|纸飞机|tele|wickr|威克|wechat|weixin|微信|威信|\bvx\b|\bwx\b|(?<![A-Za-z0-9])v[:：]|jabber|xmpp|qq|企鹅|扣扣|蝙蝠|bat|"
    r"whatsapp|phone|tel|联系|聯繫|联糸|联络|联系方式|客服|咨询|合作|拍前|找我|加我|留下|私聊|钱包|收款|付款|地址|usdt|btc|bitcoin|eth|tron|trc20|erc20|pgp|公钥)", _I,
)
RISK = re.compile(
    r"(数据|脱库|库|可验证|反向验证|注册页|账号|帐号|会员|博彩|彩票|网贷|贷款|客户|数据库|手机号|电话号码|电子邮箱|email|mailbox|full_name|password|passwd|pwd|username|account\|full_name|reg_ip|格式|字段|样例|sample|dump|leak|"
    r"credential|cvv|信用卡|身份证|通讯录|邮箱库|购买者邮箱|收货|快递)", _I,
)
WALLET_CUES = re.compile(r"(钱包|收款|付款|充值|地址|usdt|trc20|erc20|btc|bitcoin|eth|tron|wallet|address)", _I)
# Words that are no handles, hosts that identify nobody, and marks around values.
NO_HANDLES = frozenset(
    "admin contact customer service support telegram wechat wickr wallet address group channel username password account phone mobile email mail tel tg qq vx wx id handle video photo".split()
)
NO_HOSTS = ("youtube.com", "www.youtube.com", "telegram.org", "t.me", "telegram.me", "mega.nz", "nordvpn.com", "www.nordvpn.com", "expressvpn.com", "www.expressvpn.com")
MARKS = "[](){}<>,;:'\"，。；、"

SIGNALS = "entity string, item string, field string, kind string, value string, raw string, evidence string, context string, seller_facing int, risk int, direct int, support_only int, signal_uid string"


def spaced(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def url_value(raw: str) -> str:
    """A URL or domain as host and two path parts; "" for hosts that identify nobody, forum pages and what is too short or long."""
    raw = raw.strip(MARKS)
    try:
        parts = urlsplit(raw if re.match("https?://", raw, re.I) else f"http://{raw}")
    except ValueError:
        return ""
    host = parts.netloc.lower().split("@")[-1].split(":")[0].strip(".")
    if "." not in host or any(host == h or host.endswith(f".{h}") for h in NO_HOSTS):
        return ""
    path = [p for p in parts.path.split("/") if p]
    if host.endswith(".onion") and path and re.match("viewtopic|index|forum|thread", path[0], re.I):
        return ""
    out = "/".join([host, *path[:2]]).lower().rstrip("/")
    return out if 6 <= len(out) <= 160 else ""


def normal_form(kind: str, raw: str) -> str:
    """The form in which equal signals are equal; "" if the raw text is no value of its kind."""
    raw = raw.strip()
    digits = re.sub(r"\D", "", raw)
    if kind in ("email", "jabber"):
        value = raw.lower().strip(MARKS)
        local = value.split("@")[0]
        fits = re.fullmatch(r"[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,24}", value)
        return value if fits and local == local.strip(".") and ".." not in local else ""
    if kind in ("telegram", "wickr", "wechat", "bat"):
        value = re.sub(r"[^a-z0-9_.\-]", "", raw.lower().lstrip("@")).strip("._-")
        if not 5 <= len(value) <= 32 or value in NO_HANDLES:
            return ""
        number = kind == "bat" and re.fullmatch(r"[1-9][0-9]{4,11}", value)
        return value if number or (re.search("[a-z]", value) and not value.isdigit()) else ""
    if kind == "qq":
        return digits if re.fullmatch("[1-9][0-9]{4,11}", digits) else ""
    if kind == "phone":
        return digits if 7 <= len(digits) <= 15 and len(set(digits)) >= 3 else ""
    if kind == "crypto_wallet":
        value = re.sub("[^A-Za-z0-9]", "", raw)
        if re.fullmatch("bc1[ac-hj-np-z02-9]{11,71}", value, re.I) or re.fullmatch("0x[a-fA-F0-9]{40}", value):
            return value.lower()
        return value if re.fullmatch("[13][a-km-zA-HJ-NP-Z1-9]{25,34}|T[A-HJ-NP-Za-km-z1-9]{33}", value) else ""
    if kind == "pgp_fingerprint":
        value = re.sub("[^A-Fa-f0-9]", "", raw).lower()
        return value if len(value) == 40 else ""
    return url_value(raw) if kind == "external_url" else ""


def flags(kind: str, evidence: str, context: str) -> tuple[int, int, int, int]:
    """(seller_facing, risk, direct, support_only) from a signal's kind, its evidence and the text around it."""
    facing = bool(CUES.search(context)) or evidence in ("telegram_url", "pgp_public_key_block", "pgp_fingerprint") or (kind == "crypto_wallet" and bool(WALLET_CUES.search(context)))
    risk = bool(RISK.search(context))
    direct = kind != "external_url" and facing and not risk
    return int(facing), int(risk), int(direct), int(not direct)


def _mentions(text: str) -> Iterator[tuple[str, str, str, str, str, int, int]]:
    """(kind, evidence, value, raw, text it stands in, start, end) of all mentions, key blocks first."""
    for m in KEY_BLOCK.finditer(text):
        value = "pgp_sha256:" + hashlib.sha256(re.sub(r"\s+", "", m.group()).encode()).hexdigest()
        yield "pgp_public_key", "pgp_public_key_block", value, "PGP_PUBLIC_KEY_BLOCK", text, m.start(), m.end()
    plain = KEY_BLOCK.sub(" ", unicodedata.normalize("NFKC", spaced(text)))
    for kind, evidence, pattern in PATTERNS:
        for m in pattern.finditer(plain):
            group = m.lastindex or 0
            yield kind, evidence, normal_form(kind, m.group(group)), m.group(group), plain, m.start(group), m.end(group)


def signals_of(text: str, around: int = 90) -> Iterator[tuple]:
    """(kind, value, raw, evidence, context, seller_facing, risk, direct, support_only) of each value's first mention in a text.

    Texts are read in their compatibility form in one line. A bare @handle counts only if the text around it speaks of contacts.
    """
    cut = lambda x, n: x if len(x) <= n else x[: n - 3].rstrip() + "..."
    seen = set()
    for kind, evidence, value, raw, where, start, end in _mentions(text):
        if not value or (kind, value) in seen:
            continue
        seen.add((kind, value))
        context = spaced(where[max(0, start - around) : end + around])
        if evidence == "telegram_at_handle_with_context" and not CUES.search(context):
            continue
        yield kind, value, cut(spaced(raw), 180), evidence, cut(context, 260), *flags(kind, evidence, context)


def signal_uid(source: str, item: str, kind: str, value: str, field: str) -> str:
    return hashlib.sha1("|".join([source, item, kind, value, field]).encode()).hexdigest()


def extract_signals(items: DataFrame, entity: str, item: str, fields: list[str]) -> DataFrame:
    """One row for each first mention of a value in each field of each item.

    Spark's expressions give no offsets, so the texts go through Python in batches. Missing and empty texts give none.
    """
    ship(items.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for e, i, *texts in frame.itertuples(index=False):
                for f, t in zip(fields, texts, strict=True):
                    rows += [(e, i, f, *s, signal_uid(str(e), str(i), s[0], s[1], f)) for s in (signals_of(t) if t else ())]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNALS.split(", ")])

    return items.select(F.col(entity).cast("string").alias("entity"), F.col(item).cast("string").alias("item"), *fields).mapInPandas(run, SIGNALS)


def in_context(kind: str, value: str, context: str) -> bool:
    """Whether a value stands in a text; of phones the digits are compared."""
    if kind == "phone":
        digits = re.sub(r"\D", "", value)
        return bool(digits) and digits in re.sub(r"\D", "", context)
    return value.lower() in context.lower()


def signal_index(signals: DataFrame, kinds: list[str], excluded: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """(entity, contacts as sorted "kind:value") of usable signals, and how many were left out for each reason."""
    value = F.lower("value")
    hit = F.lit(False)
    for kind, values in excluded.items():
        hit = hit | (value.isin(*values) & (F.lit(True) if kind == "*" else F.col("kind") == kind) if values else F.lit(False))
    reason = F.when(~F.col("kind").isin(*kinds), "kind").when(hit, "excluded_value").when(F.col("risk") > 0, "risk").when(F.col("direct") == 0, "not_direct")
    marked = signals.withColumn("reason", reason)
    index = marked.filter("reason is null").groupBy("entity").agg(F.array_sort(F.collect_set(F.concat_ws(":", "kind", "value"))).alias("contacts"))
    return index, marked.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("signals"))
