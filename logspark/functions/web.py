"""URL, referrer, user-agent and trace-header columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from logspark.functions.json import let
from logspark.functions.text import ascii_lower


# Campaign parameters moved from the query to the utm map.
UTM_KEYS = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]

# Campaign mediums kept as given; any other becomes "campaign".
UTM_MEDIUMS = ["organic", "social", "email", "paid", "referral", "direct", "cpc", "affiliate"]

# Host fragments and the source they stand for.
AI_HOSTS = {
    "chatgpt.com": "chatgpt",
    "chat.openai.com": "chatgpt",
    "claude.ai": "claude",
    "perplexity.ai": "perplexity",
    "gemini.google.com": "gemini",
    "copilot.microsoft.com": "copilot",
    "grok.com": "grok",
    "x.ai": "grok",
    "deepseek.com": "deepseek",
    "chat.deepseek.com": "deepseek",
    "poe.com": "poe",
    "you.com": "you",
    "phind.com": "phind",
}
SEARCH_HOSTS = {
    "google.": "google",
    "bing.com": "bing",
    "duckduckgo.com": "duckduckgo",
    "search.yahoo.com": "yahoo",
    "yandex.": "yandex",
    "baidu.com": "baidu",
    "ecosia.org": "ecosia",
    "startpage.com": "startpage",
}
SOCIAL_HOSTS = {
    "t.co": "twitter",
    "twitter.com": "twitter",
    "x.com": "twitter",
    "facebook.com": "facebook",
    "instagram.com": "instagram",
    "linkedin.com": "linkedin",
    "reddit.com": "reddit",
    "youtube.com": "youtube",
    "tiktok.com": "tiktok",
    "pinterest.com": "pinterest",
    "news.ycombinator.com": "hn",
    "mastodon.": "mastodon",
    "whatsapp.com": "whatsapp",
    "t.me": "telegram",
}
REFERRER_GROUPS = [("ai", AI_HOSTS), ("organic", SEARCH_HOSTS), ("social", SOCIAL_HOSTS)]

# Fragments that mark automated clients.
BOT_WORDS = [
    "bot", "crawler", "spider", "slurp", "crawl", "curl/", "wget", "python-requests",
    "python-urllib", "go-http-client", "java/", "apache-httpclient", "headless",
    "phantomjs", "lighthouse", "pagespeed", "uptime", "monitoring", "pingdom",
    "datadog", "semrush", "ahrefs", "mj12", "dotbot", "petalbot", "bytespider",
    "facebookexternalhit", "embedly", "preview", "scanner", "zgrab", "masscan",
    "nikto", "nmap", "okhttp", "libwww", "httpie",
]

# First matching family wins.
BROWSERS = [
    ("Edge", ["edg/", "edge/", "edga/", "edgios/"]),
    ("Opera", ["opr/", "opera"]),
    ("Samsung Internet", ["samsungbrowser"]),
    ("Firefox", ["firefox", "fxios"]),
    ("Chrome", ["crios", "chrome", "chromium"]),
    ("Safari", ["safari"]),
    ("IE", ["msie", "trident/"]),
]
SYSTEMS = [
    ("Windows", ["windows"]),
    ("iOS", ["iphone", "ipod"]),
    ("iPadOS", ["ipad"]),
    ("macOS", ["mac os x", "macintosh"]),
    ("Android", ["android"]),
    ("ChromeOS", ["cros"]),
    ("Linux", ["linux", "x11"]),
]
DEVICES = ["desktop", "mobile", "tablet", "bot"]


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in words)


def split_url_utm(url: Column) -> Column:
    """Struct (path, query, utm): the query keeps no ``utm_*`` pair, utm is NULL when empty."""
    return let(url, _url_parts)


def _url_parts(url: Column) -> Column:
    path = F.substring_index(url, "?", 1)
    query = F.when(F.contains(url, F.lit("?")), F.regexp_replace(url, r"(?s)^[^?]*\?", ""))
    pairs = F.filter(F.split(F.coalesce(query, F.lit("")), "&"), lambda p: p != "")
    keyed = F.transform(
        pairs,
        lambda p: F.struct(
            p.alias("pair"),
            ascii_lower(F.substring_index(p, "=", 1)).alias("key"),
            F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, r"(?s)^[^=]*=", ""))
            .otherwise("")
            .alias("value"),
        ),
    )

    def parts(keyed: Column) -> Column:
        kept = F.filter(keyed, lambda e: ~F.startswith(e["key"], F.lit("utm_")))
        query_out = F.array_join(F.transform(kept, lambda e: e["pair"]), "&")

        def last_of(key: str) -> Column:
            hits = F.filter(keyed, lambda e: (e["key"] == key) & (e["value"] != ""))
            return F.try_element_at(hits, F.lit(-1))["value"]

        found = F.map_filter(
            F.create_map(
                *[x for key in UTM_KEYS for x in (F.lit(key.removeprefix("utm_")), last_of(key))]
            ),
            lambda _, v: v.isNotNull(),
        )
        utm = let(found, lambda f: F.when(F.size(f) > 0, f))
        return F.struct(path.alias("path"), query_out.alias("query"), utm.alias("utm"))

    return let(keyed, parts)


def host_of(url: Column) -> Column:
    after = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise(url)
    return F.substring_index(after, "/", 1)


def origin_host(origin: Column) -> Column:
    """Host of an origin with a scheme; NULL without one."""
    return F.when(F.contains(origin, F.lit("://")), F.nullif(host_of(origin), F.lit("")))


def classify_referrer(referrer: Column, utm: Column, own_host: Column) -> Column:
    """Struct (source, medium). Campaign tags first, then direct, AI, search, social, referral."""
    parts = {
        "tag": utm["source"], "medium": F.coalesce(utm["medium"], F.lit("campaign")), "referrer": F.coalesce(referrer, F.lit("")),
        "host": ascii_lower(host_of(F.coalesce(referrer, F.lit("")))), "own": ascii_lower(F.coalesce(own_host, F.lit(""))),
    }
    return let(F.struct(*[c.alias(k) for k, c in parts.items()]), _source_medium)


def _source_medium(parts: Column) -> Column:
    tag, medium, referrer, host, own = (parts[k] for k in ("tag", "medium", "referrer", "host", "own"))
    direct = (referrer == "") | ((own != "") & (host == own))

    source = F.when(tag.isNotNull(), tag).when(direct, "direct")
    kind = F.when(
        tag.isNotNull(), F.when(medium.isin(UTM_MEDIUMS), medium).otherwise("campaign")
    ).when(direct, "direct")
    for name, hosts in REFERRER_GROUPS:
        for fragment, label in hosts.items():
            source = source.when(F.contains(host, F.lit(fragment)), label)
        kind = kind.when(host.rlike(any_of(list(hosts))), name)
    return F.struct(
        source.otherwise(host).alias("source"),
        kind.otherwise("referral").alias("medium"),
    )


def classify_user_agent(agent: Column) -> Column:
    """Struct (device, browser, os, is_bot); unknown parts are empty text."""
    low = ascii_lower(F.coalesce(agent, F.lit("")))
    return let(low, lambda x: let(x.rlike(any_of(BOT_WORDS)), lambda bot: _agent_parts(x, bot)))


def _agent_parts(low: Column, bot: Column) -> Column:
    blank = low == ""

    def family(rules):
        out = F.when(blank | bot, "")
        for label, words in rules:
            out = out.when(low.rlike(any_of(words)), label)
        return out.otherwise("")

    android = low.contains("android")
    device = (
        F.when(blank, "")
        .when(bot, "bot")
        .when(low.rlike("ipad|tablet") | (android & ~low.contains("mobile")), "tablet")
        .when(low.rlike("mobile|iphone|ipod|android"), "mobile")
        .otherwise("desktop")
    )
    return F.struct(
        device.alias("device"),
        family(BROWSERS).alias("browser"),
        family(SYSTEMS).alias("os"),
        bot.alias("is_bot"),
    )


def split_traceparent(header: Column) -> Column:
    """Struct (trace_id, span_id) of a four-part ``00-`` header; empty text when malformed."""

    def ids(parts: Column) -> Column:
        good = (F.size(parts) == 4) & (F.get(parts, 0) == "00")
        return F.struct(
            F.when(good, ascii_lower(F.get(parts, 1))).otherwise("").alias("trace_id"),
            F.when(good, ascii_lower(F.get(parts, 2))).otherwise("").alias("span_id"),
        )

    return let(F.split(F.coalesce(header, F.lit("")), "-"), ids)


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text as a number, NULL for anything else."""
    octets = F.split(F.when(ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), ip), r"\.")
    nums = [F.get(octets, i).try_cast("long") for i in range(4)]
    valid = nums[0].between(0, 255)
    for n in nums[1:]:
        valid = valid & n.between(0, 255)
    value = nums[0] * 16777216 + nums[1] * 65536 + nums[2] * 256 + nums[3]
    return F.when(valid, value)


def ip6_halves(ip: Column) -> Column:
    """IPv6 text as struct (high, low) of its 64-bit halves, NULL for anything else.

    Groups may be shortened by ``::`` once, in either case of letters, and end in a dotted IPv4 part.
    """

    def without_dots(text: Column) -> Column:
        def hexed(tail: Column) -> Column:
            word = lambda n: F.lower(F.hex(n.cast("long")))
            return F.concat(F.regexp_extract(text, "^(.*:)[0-9.]+$", 1), word(F.floor(tail / 65536)), F.lit(":"), word(F.pmod(tail, F.lit(65536))))

        return F.when(F.contains(text, F.lit(".")), let(ip_number(F.regexp_extract(text, "([0-9.]+)$", 1)), hexed)).otherwise(text)

    def groups(side: Column) -> Column:
        return F.when(side == "", F.array().cast("array<string>")).otherwise(F.split(side, ":", -1))

    def eight(sides: Column) -> Column:
        """All eight groups, or an array of another length."""
        def filled(x: Column) -> Column:
            missing = 8 - F.size(x["l"]) - F.size(x["r"])
            return F.when((F.size(sides) == 2) & (missing >= 1), F.concat(x["l"], F.array_repeat(F.lit("0"), missing), x["r"])).when(F.size(sides) == 1, x["l"])

        return let(F.struct(groups(F.get(sides, F.lit(0))).alias("l"), groups(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("r")), filled)

    def halves(whole: Column) -> Column:
        digits = F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), "")
        half = lambda d, start: F.conv(F.substring(d, start, 16), 16, -10).cast("long")
        both = let(digits, lambda d: F.struct(half(d, 1).alias("high"), half(d, 17).alias("low")))
        return F.when((F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$")), both)

    text = F.lower(F.when(ip.rlike("^[0-9A-Fa-f:]*:[0-9A-Fa-f:.]*$") & ~F.contains(ip, F.lit(":::")), ip))
    return let(text, lambda t: let(F.split(without_dots(t), "::", -1), lambda sides: let(eight(sides), halves)))


def address_key(ip: Column) -> Column:
    """Struct (family 4 or 6, high, low) of an address; IPv4 numbers stand in ``high``. NULL for other text."""

    def key(x: Column) -> Column:
        four = F.struct(F.lit(4).alias("family"), x["four"].alias("high"), F.lit(0).cast("long").alias("low"))
        six = F.struct(F.lit(6).alias("family"), x["six"]["high"].alias("high"), x["six"]["low"].alias("low"))
        return F.when(x["four"].isNotNull(), four).when(x["six"].isNotNull(), six)

    return let(F.struct(let(ip, ip_number).alias("four"), ip6_halves(ip).alias("six")), key)


def address_prefix(key: Column, bits: Column) -> tuple[Column, Column]:
    """The first ``bits`` bits of an address key, as two numbers that are equal for equal prefixes."""

    def first(value: Column, n: Column, width: int) -> Column:
        shifted = F.call_function("shiftrightunsigned", value, (width - n).cast("int"))
        return F.when(n <= 0, F.lit(0).cast("long")).when(n >= width, value).otherwise(shifted)

    four = key["family"] == 4
    return F.when(four, first(key["high"], bits, 32)).otherwise(first(key["high"], bits, 64)), first(key["low"], bits - 64, 64)


def network(cidr: Column) -> Column:
    """Struct (family, bits, p1, p2) of a block in CIDR text, a bare address being a block of one; NULL for other text."""

    def block(x: Column) -> Column:
        key, width = x["key"], F.when(x["key"]["family"] == 4, 32).otherwise(128)
        bits = F.when(F.size(x["parts"]) == 1, width).when((F.size(x["parts"]) == 2) & F.get(x["parts"], F.lit(1)).rlike("^[0-9]{1,3}$"), F.get(x["parts"], F.lit(1)).cast("int"))

        def prefix(n: Column) -> Column:
            p1, p2 = address_prefix(key, n)
            return F.when(key.isNotNull() & (n <= width), F.struct(key["family"].alias("family"), n.alias("bits"), p1.alias("p1"), p2.alias("p2")))

        return let(bits, prefix)

    parts = F.split(cidr, "/", -1)
    return let(F.struct(parts.alias("parts"), address_key(F.trim(F.get(parts, F.lit(0)))).alias("key")), block)
