"""Members that false magics cut in many pieces: each piece is decompressed once, and nothing is lost."""

import random
import time
import zlib

from provenant.llm import warc


def _pieces(data):
    return data.split(warc.MAGIC)[1:]


def _stored(body):
    """A record in a member that isn't compressed, so its payload's magics stand in it."""
    head = b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(head + body + b"\r\n\r\n") + packer.flush()


def test_false_magics():
    rng = random.Random(3)
    bodies = [b"".join(rng.choice([warc.MAGIC, b"abc", rng.randbytes(40)]) for _ in range(rng.choice((0, 1, 30, 200)))) for _ in range(40)]
    joiner, got = warc._Joiner(), []
    for piece in _pieces(b"".join(map(_stored, bodies))):
        got += joiner.add(piece)
    got += joiner.close()
    assert [k for k, _ in got] == ["record"] * len(bodies) and [warc.parse(d)["block"] for _, d in got] == bodies


def test_a_broken_member_is_loose():
    data = bytearray(_stored(b"x" * 50 + warc.MAGIC + b"y" * 50 + warc.MAGIC + b"z" * 50))
    data[-6] ^= 255  # its check sum
    joiner = warc._Joiner()
    pieces = _pieces(bytes(data)) + _pieces(_stored(b"next"))
    got = [x for p in pieces for x in joiner.add(p)] + list(joiner.close())
    assert [k for k, _ in got] == ["loose", "record"] and got[0][1] == bytes(data) and warc.parse(got[1][1])["block"] == b"next"


def test_time_is_linear():
    def seconds(n):
        data = _stored((warc.MAGIC + b"0123456789" * 10) * n)
        began, joiner = time.process_time(), warc._Joiner()
        assert [k for p in _pieces(data) for k, _ in joiner.add(p)] == ["record"]
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 8 * 4 * max(seconds(2000), 0.02)
