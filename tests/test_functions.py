"""Keys, hashes, clock, crypto."""

import pytest
from pyspark.sql import functions as F

from tallyhold.errors import ConfigError
from tallyhold.functions import crypto, hashing
from tallyhold.functions.clock import HybridClock, ticked


@pytest.mark.parametrize("raw", [b"/a/b", "/é/日".encode(), b"\xc3\x28", b"\x80\x81", b"", b"\x00x"])
def test_path_keys_keep_all_bytes(spark, raw):
    df = spark.createDataFrame([(bytearray(raw),)], "raw binary").withColumn("key", hashing.path_key(F.col("raw")))
    r = df.select("key", hashing.is_escaped(F.col("key")).alias("e"), hashing.path_bytes(F.col("key")).alias("b"), hashing.path_display(F.col("key")).alias("d")).first()
    assert bytes(r.b) == raw
    plain = raw[:1] != b"\x00" and raw.decode("utf-8", "replace").encode() == raw
    assert r.e == (not plain) and r.key == (raw.decode() if plain else "\x00" + raw.hex()) and r.d == (raw.decode() if plain else f"<bytes:{raw.hex()}>")


def test_object_keys_and_arithmetic(spark):
    h = "ab" * 32
    df = spark.createDataFrame([(h, 7)], "h string, n long")
    r = df.select(hashing.segment_key(F.col("h"), F.col("n")).alias("s"), hashing.parse_segment_key(F.lit(f"log/{h}/00000000000000000007.seg")).alias("p"), hashing.parse_segment_key(F.lit("log/x/7.seg")).alias("no"), hashing.age(F.lit(3), F.lit(5)).alias("age"), hashing.seconds(F.lit(2**62)).alias("most")).first()
    assert r.s == f"log/{h}/00000000000000000007.seg" and tuple(r.p) == (h, 7) and r.no is None and r.age == 0 and r.most == 2**63 - 1
    with pytest.raises(Exception, match="99"):
        df.select(hashing.supported(F.lit(99))).collect()


def test_entry_hash_tells_fields_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc")], "x string, y string")
    assert df.select(hashing.body_hash("x", "y").alias("h")).distinct().count() == 4


def test_roots_are_whole_names(spark):
    df = spark.createDataFrame([("/data",), ("/data/a",), ("/data2/a",)], "p string")
    assert [r.p for r in df.where(hashing.under(F.col("p"), "/data/")).collect()] == ["/data", "/data/a"]


def test_clock(spark):
    wall = iter([100, 90, 90, 300])
    clock = HybridClock(0, lambda: next(wall))
    assert [clock.tick(), clock.tick()] == [100, 101]
    clock.witness(200)
    assert [clock.tick(), clock.tick()] == [201, 300]
    df = spark.createDataFrame([("m", i, w) for i, w in enumerate([5, 5, 5, 9, 2])], "machine string, i long, wall long")
    assert [r.hlc for r in ticked(df, "wall", order=["i"]).orderBy("i").collect()] == [5, 6, 7, 9, 10]


def test_ed25519_vector():
    key = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    public = "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    assert crypto.public_key(key).hex() == public
    sig = crypto.sign(key, b"")
    assert sig.hex().startswith("e5564300c360ac729086e2cc806e828a") and sig.hex().endswith("24655141438e7a100b")
    assert crypto.verify(bytes.fromhex(public), b"", sig) and not crypto.verify(bytes.fromhex(public), b"x", sig)
    assert not crypto.verify(bytes.fromhex(public), b"", sig[:63] + b"\xff") and not crypto.verify(b"short", b"", sig)


def test_encryption_is_convergent_and_authentic(spark):
    own = crypto.Encrypt.from_passphrase("pass", b"salt")
    df = spark.createDataFrame([(bytearray(b"hello"),), (bytearray(b""),), (bytearray(b"hello"),)], "d binary").withColumn("s", own.apply(F.col("d")))
    rows = df.select("d", "s", own.reverse(F.col("s")).alias("back"), crypto.Encrypt(bytes(32)).reverse(F.col("s")).alias("wrong"), own.reverse(F.substring("s", 1, 20)).alias("short")).collect()
    assert [len(r.s) for r in rows] == [33, 28, 33] and rows[0].s == rows[2].s
    assert all(r.back == r.d and r.wrong is None and r.short is None for r in rows)
    with pytest.raises(ConfigError):
        crypto.Encrypt(b"short")


WORDS = [a + b + c for a in "bcdfghjklmnpqrst" for b in "aeiouywv" for c in "bcdfghjklmnpqrst"]


def test_recovery_phrases():
    test = "abandon " * 11 + "about"
    assert crypto.mnemonic_seed(test).hex().startswith("5eb00bbd")
    words = crypto.WordList(WORDS)
    for n in words.COUNTS:
        phrase = words.generate(n)
        assert len(phrase.split()) == n and words.encode(words.validate(phrase)) == phrase
    broken = phrase.split()
    broken[-1] = WORDS[WORDS.index(broken[-1]) ^ 1]
    with pytest.raises(ConfigError):
        words.validate(" ".join(broken))
    assert crypto.Encrypt.from_mnemonic(test).key == crypto.Encrypt.from_mnemonic(test + " ").key


def test_phrase_entry():
    words = crypto.WordList(WORDS)

    def after(entry, *keys):
        for key in keys:
            entry = crypto.typed(words, 12, entry, key)
        return entry

    none = crypto.Entry()
    assert after(none, "z") == after(none, "enter") == after(none, "1") == after(none, "back") == none and not crypto.offered(words, none)
    assert after(none, "B", "a").letters == "ba" and not crypto.offered(words, after(none, "b", "a"))
    three = after(none, "b", "a", "b")
    assert crypto.offered(words, three)["1"] == "bab" and after(three, "1") == after(three, "enter") == crypto.Entry(("bab",))
    assert after(three, "enter", "back") == three and after(three, "back").letters == "ba"
    phrase = words.generate(12).split()
    whole = none
    for w in phrase:
        whole = after(whole, *w, "enter")
    assert whole == crypto.Entry(tuple(phrase)) and after(whole, "b") == whole and words.validate(" ".join(whole.done))
    assert after(whole, "back").done == tuple(phrase[:-1])
    with pytest.raises(ConfigError):
        crypto.typed(words, 13, none, "a")


def test_machine_key(tmp_path):
    path = tmp_path / "k" / "key"
    assert crypto.load_or_create_key(str(path)) == crypto.load_or_create_key(str(path)) and path.stat().st_mode & 0o077 == 0
    path.write_bytes(b"x")
    with pytest.raises(ConfigError):
        crypto.load_or_create_key(str(path))


def test_base_multiples_are_those_of_doubling_and_adding_with_an_addition_a_digit(monkeypatch):
    """a signature takes one multiple of the base, of few additions; the secret's own is kept."""
    for n in (0, 1, 2, 63, 64, crypto._L - 1, crypto._L, 2**255 - 1, 2**256 - 1, 0x1234567890ABCDEF << 180):
        assert crypto._encode(crypto._times_base(n)) == crypto._encode(crypto._times(n, crypto._BASE))
    crypto.sign(b"k" * 32, b"")
    calls, add = [], crypto._add
    monkeypatch.setattr(crypto, "_add", lambda a, b: calls.append(1) or add(a, b))
    assert crypto.verify(crypto.public_key(b"k" * 32), b"m", sig := crypto.sign(b"k" * 32, b"m")) and len(sig) == 64
    calls.clear()
    crypto.sign(b"k" * 32, b"n")
    assert len(calls) < 60
