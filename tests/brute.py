"""Plain Python versions of the column functions, for comparison in tests."""

import ipaddress


def network(text):
    if text is None or not "".join(text.split()):
        return None
    s = "".join(text.split()).lower()
    try:
        host, _, length = s.partition("/")
        host = ".".join(str(int(x)) for x in host.split(".")) if "." in host and ":" not in host else host
        return str(ipaddress.ip_network(f"{host}/{length}" if length else host, strict=False))
    except ValueError:
        return s


def address(text):
    full = network(text)
    return full if full is None else full.partition("/")[0]


def as_number(text):
    s = "".join((text or "").split()).lower().removeprefix("as")
    if not s:
        return None
    high, dot, low = s.partition(".")
    return str(int(high) * 65536 + int(low)) if dot else str(int(s)) if s.isdigit() else s


def clean(raw):
    """The rules one by one: sets, numbers, private and reserved numbers, repeats."""
    kept, inside = [], False
    for token in (raw or "").split():
        inside = inside or "{" in token
        if inside:
            inside = "}" not in token
        elif token.isascii() and token.isdigit():
            n = int(token)
            special = n in (0, 23456, 65535, 4294967295) or 64512 <= n <= 65534 or 4200000000 <= n <= 4294967294
            if not special and kept[-1:] != [n]:
                kept.append(n)
    return " ".join(map(str, kept))


def levenshtein(a, b):
    if not a or not b:
        return 0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
