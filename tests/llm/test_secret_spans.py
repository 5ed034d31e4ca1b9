"""Secret spans on random and crafted texts: nothing is lost to shortcuts, and time stays bounded."""

import base64
import json
import random
import re
import time

import pyarrow as pa
import pytest
from test_scans import B64, ED25519, KEY, OPENSSH_KEY, PEM, SEC1

from textloom.llm import secrets

SHORT = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"x"}', b'{"a":1}', b"sig"))


def b64url(value):
    return base64.urlsafe_b64encode(json.dumps(value).encode()).decode().rstrip("=")


def parsed(part):
    body = part.translate(str.maketrans("-_", "+/"))
    try:
        value = json.loads(base64.b64decode(body + "=" * (-len(body) % 4), validate=True).decode()) if len(body) % 4 != 1 else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


def brute_tokens(text):
    """Every header that starts at a part's start or after a character that isn't alphanumeric, tried as a whole."""
    out, done = [], -1
    for m in re.finditer(r"(?=((?<![A-Za-z0-9_-])[A-Za-z0-9_-]+\.|(?<=\.)[A-Za-z0-9_-]+\.))", text):
        if m.start() < done:
            continue
        header = re.compile(r"[A-Za-z0-9_-]*").match(text, m.start())
        payload = re.compile(r"\.([A-Za-z0-9_-]*)\.([A-Za-z0-9_-]*)").match(text, header.end())
        if not payload:
            continue
        for begin in range(len(header[0])):
            part = header[0][begin:]
            if begin and (header[0][begin - 1].isalnum() or part[:2] not in ("ey", "ew")):
                continue
            head, body = parsed(part), parsed(payload[1])
            if head and isinstance(head.get("alg"), str) and (body or "enc" in head):
                done = payload.end()
                out.append((m.start() + begin, done))
                break
    return out


def brute_blocks(text):
    """Pairs of an end marker and the last begin marker of its label since that label's last end."""
    out = []
    for end in re.finditer(r"-----END ((?:[A-Z0-9]+ ){0,3}PRIVATE KEY)-----", text):
        before = [b for b in re.finditer(re.escape(f"-----BEGIN {end[1]}-----"), text[: end.start()])]
        closed = [e for e in re.finditer(re.escape(f"-----END {end[1]}-----"), text[: end.start()])]
        if before and (not closed or closed[-1].start() < before[-1].start()):
            body = text[before[-1].end() : end.start()].replace("\\n", "\n")
            plain = "".join(line.strip() for line in body.split("\n") if ":" not in line)
            data = secrets.unbase64(plain)
            sealed = re.search(r"^\s*(Proc-Type|DEK-Info):", body, re.M)
            if data and (secrets.is_der_key(data) or secrets.is_ssh_key(data) or sealed and len(data) % 8 == 0):
                out.append((before[-1].start(), end.end()))
    return out


def random_text(rng):
    pieces = (
        SHORT, SHORT[:-3], "a." + SHORT, b64url({"alg": "none"}) + "." + b64url({"é": [1, {"x": None}]}) + ".", b64url({"alg": "A", "enc": "B"}) + ".x.y", "x-" + SHORT,
        "eyJ", "e30", ".", "..", "-", "_", " ", "\n", "\\n", "word", "A1b2", PEM, PEM.replace("\n", "\\n"), PEM.replace("BEGIN RSA", "BEGIN DSA"), "-----BEGIN RSA PRIVATE KEY-----\n",
        "-----END RSA PRIVATE KEY-----", B64, B64[:70], KEY.hex(), base64.b64encode(OPENSSH_KEY).decode(), base64.b64encode(SEC1).decode(), base64.b64encode(ED25519).decode(),
        "\n".join(re.findall(".{1,14}", base64.b64encode(OPENSSH_KEY).decode())), "token=abcdef", "0123456789abcdef" * 2, "é",
    )
    return "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9)))


def test_short_token_is_found(spark):
    df = spark.createDataFrame([(1, f"see {SHORT} here")], "doc_id bigint, text string")
    assert secrets.op2_secrets(df).first().spans == f"jwt:4:{4 + len(SHORT)}"


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    rng = random.Random(seed)
    texts = [random_text(rng) for _ in range(300)]
    for text, runs in zip(texts, secrets.with_runs(pa.array(texts)), strict=True):
        found = secrets.scan(text)
        assert secrets.scan(text, bool(runs)) == found
        assert [(a, b) for a, b, k in found if k == "jwt"] == brute_tokens(text), text
        assert [(a, b) for a, b, k in found if k == "pem"] == brute_blocks(text), text


def test_wrapped_key_in_short_lines_is_found():
    text = "\n".join(re.findall(".{1,14}", base64.b64encode(OPENSSH_KEY).decode()))
    assert [k for *_, k in secrets.scan(text, bool(secrets.with_runs(pa.array([text]))[0]))] == ["b64key"]


@pytest.mark.parametrize(
    "unit",
    [B64[:16], B64[:40], "-eyJhbGciOi", "-" + b64url({"alg": "x"}), "b3BlbnNzaC1rZXktdjEA", KEY[:24].hex(), "-----BEGIN RSA PRIVATE KEY-----\n" + B64[:64], "eyJhIjp7ImEiOns", SHORT[:-3]],
)
def test_crafted_megabytes_end_soon(unit):
    text = unit * ((1 << 20) // len(unit))
    for whole in (text, text + ".e30.x"):
        began = time.process_time()
        secrets.scan(whole)
        assert time.process_time() - began < 5
