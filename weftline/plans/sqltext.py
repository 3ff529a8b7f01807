"""SQL spellings of the text expressions, for the oracles."""

URL = r"http\S+|www\S+"
URL_STRICT = r"https?://\S+|www\.\S+"
MENTION = r"@[\pL\pN_]+"
HASHTAG = r"#([\pL\pN_]+)"
NON_WORD = r"[^\pL\pN_\s]"


def rep(x: str, pattern: str, by: str) -> str:
    return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"


def squeeze(x: str) -> str:
    return f"trim({rep(x, chr(92) + 's+', ' ')})"


def clean(x: str, gap: str = "") -> str:
    y = rep(rep(f"lower({x})", URL, gap), MENTION, gap)
    return squeeze(rep(rep(y, HASHTAG, r"\1"), NON_WORD, " "))


def stable_hash(x: str) -> str:
    return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"
