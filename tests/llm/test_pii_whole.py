"""Detections that must cover the whole entity."""

import ipaddress
import random

from weftgraph.llm import pii


def test_secrets_of_any_length_and_with_prefixed_names():
    r, s = random.Random(3), pii.Surrogates()
    for n in (512, 513, 900, 20_000):
        value = "".join(r.choice("abcdefXYZ0123456789") for _ in range(n))
        for text in (f'token="{value}" end', f"secret: '{value}' end", f"api_key={value} end"):
            new, found = pii.replace(text, s)
            assert [text[a:b] for _, a, b, _, _ in found] == [value]
            assert all(value[k : k + 12] not in new for k in range(n - 11)) and len(new) == len(text) and new.endswith(" end") == text.endswith(" end")
    for name in ("client_secret", "access_token", "db_password", "my-api-key", "DB_PASSWORD"):
        assert [e[0] for e in pii.replace(f"{name}=abcdef0123456789abcdef", s)[1]] == ["secret"], name
    assert not pii.detect("subtoken=abcdef0123456789abcdef")
    same = "a1" * 256
    assert s("secret", same + "xyz") != s("secret", same + "xyw") and s("secret", "F1" * 400).isupper()


def test_ipv6_in_all_writings():
    s = pii.Surrogates()
    for own in ("2001:db8::8a2e:370:7334", "2001:0db8:0000:0000:0000:8a2e:0370:7334", "FE80::1A2B", "::1", "2001:db8::", "::ffff:10.1.2.3", "1:2:3:4:5:6:7:8"):
        new, found = pii.replace(f"from {own}, at 12:30:45.", s)
        assert [(e[0], own) for e in found] == [("ipv6", own)], own
        surrogate = found[0][3]
        assert ipaddress.IPv6Address(surrogate) != ipaddress.IPv6Address(own) and new == f"from {surrogate}, at 12:30:45."
        assert surrogate.count(":") == own.count(":") and surrogate.count(".") == own.count(".") and surrogate.isupper() == own.isupper()
    assert not pii.detect("std::vector and :: and 10:20:30 and a:b:c")
    assert len({s("ipv6", f"2001:db8::{k:x}") for k in range(0x1000, 0x1400)}) == 0x400


def test_names_after_honorifics():
    s = pii.Surrogates()
    for text in ("Dr. Aisha Khan called; Khan left, Aisha too.", "Prof. Dr. Aisha Noor Khan met Mr Khan.", "Anna Maria Khan left.", "Mr. Peter Khan left."):
        new, found = pii.replace(text, s)
        assert not any(name in new for name in ("Aisha", "Noor", "Khan", "Anna", "Maria", "Peter")), new
        assert "Dr" not in text or "Dr." in new
        assert {e[0] for e in found if text[e[1] : e[2]] == "Khan"} == {"family"} and {e[0] for e in found if text[e[1] : e[2]] == "Aisha"} <= {"given"}


def test_one_entity_in_several_writings():
    s = pii.Surrogates()
    for kind, *writings in (
        ("card", "4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"),
        ("iban", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00"),
        ("phone", "+16405550953", "+1 (640) 555-0953", "+1 640-555-0953", "+1.640.555.0953"),
        ("ipv6", "2001:db8::8a2e:370:7334", "2001:DB8:0:0:0:8A2E:370:7334", "2001:0db8:0000::8a2e:0370:7334"),
    ):
        found = [pii.replace(w, s)[1] for w in writings]
        assert [[e[0] for e in x] for x in found] == [[kind]] * len(writings)
        assert len({x[0][4] for x in found}) == 1, kind
        assert len({s._canonical(kind, x[0][3]) for x in found}) == 1, kind
        assert all("".join(c for c in x[0][3] if c in " -.()") == "".join(c for c in w if c in " -.()") for x, w in zip(found, writings))
    numbers = {f"+1 (640) 5{k // 100:02d}-{k % 100:02d}00" for k in range(800)}
    assert len({s.phone(x) for x in numbers}) == len(numbers) and not any(s.phone(x) == x for x in numbers)
