"""The standard security handler: RC4 and AES, revisions 2 to 6, user or owner password."""

from __future__ import annotations

import hashlib

import numpy as np

from .objects import Name, Stream

#: Fixed value: the padding string of the standard security handler.
PAD = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, c in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = c ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def _times(a: int, b: int) -> int:
    r = 0
    while b:
        r, a, b = r ^ (a if b & 1 else 0), (a << 1) ^ (0x11B if a & 128 else 0), b >> 1
    return r


def _sbox() -> tuple[np.ndarray, np.ndarray]:
    box = np.zeros(256, np.uint8)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        box[x] = inv ^ (inv << 1 | inv >> 7) & 255 ^ (inv << 2 | inv >> 6) & 255 ^ (inv << 3 | inv >> 5) & 255 ^ (inv << 4 | inv >> 4) & 255 ^ 0x63
    back = np.zeros(256, np.uint8)
    back[box] = np.arange(256)
    return box, back


_tables: list = []


def _aes_tables():
    if not _tables:
        _tables.extend([*_sbox(), {m: np.array([_times(x, m) for x in range(256)], np.uint8) for m in (2, 3, 9, 11, 13, 14)}])
    return _tables


def _round_keys(key: bytes) -> np.ndarray:
    box = _aes_tables()[0]
    n, rounds = len(key) // 4, len(key) // 4 + 6
    w, rcon = [list(key[4 * k : 4 * k + 4]) for k in range(n)], 1
    for k in range(n, 4 * (rounds + 1)):
        t = list(w[-1])
        if k % n == 0:
            t = [int(box[x]) for x in t[1:] + t[:1]]
            t[0] ^= rcon
            rcon = _times(rcon, 2)
        elif n > 6 and k % n == 4:
            t = [int(box[x]) for x in t]
        w.append([a ^ b for a, b in zip(w[k - n], t, strict=True)])
    return np.array(w, np.uint8).reshape(rounds + 1, 16)


_SHIFT = np.array([(c * 4 + r + 4 * r) % 16 for c in range(4) for r in range(4)])
_UNSHIFT = np.argsort(_SHIFT)


def _mix(s: np.ndarray, m: tuple[int, int, int, int]) -> np.ndarray:
    t = _aes_tables()[2]
    mul = lambda k, a: a if k == 1 else t[k][a]
    s = s.reshape(-1, 4, 4)
    return np.stack([mul(m[-r % 4], s[:, :, 0]) ^ mul(m[(1 - r) % 4], s[:, :, 1]) ^ mul(m[(2 - r) % 4], s[:, :, 2]) ^ mul(m[(3 - r) % 4], s[:, :, 3]) for r in range(4)], 2).reshape(-1, 16)


def aes_blocks(key: bytes, data: bytes, encrypt: bool = False) -> np.ndarray:
    """ECB over all blocks at once."""
    box, back, _ = _aes_tables()
    k = _round_keys(key)
    s = np.frombuffer(data, np.uint8).reshape(-1, 16)
    if encrypt:
        s = s ^ k[0]
        for r in range(1, len(k)):
            s = box[s][:, _SHIFT]
            s = (s if r == len(k) - 1 else _mix(s, (2, 3, 1, 1))) ^ k[r]
        return s
    s = s ^ k[-1]
    for r in range(len(k) - 2, -1, -1):
        s = back[s[:, _UNSHIFT]] ^ k[r]
        if r:
            s = _mix(s, (14, 11, 13, 9))
    return s


def aes_cbc_decrypt(key: bytes, data: bytes, iv: bytes | None = None, unpad: bool = True) -> bytes:
    if iv is None:
        iv, data = data[:16], data[16:]
    data = data[: len(data) // 16 * 16]
    if not data or len(iv) < 16:
        return b""
    prev = np.frombuffer(iv + data[:-16], np.uint8).reshape(-1, 16)
    out = (aes_blocks(key, data) ^ prev).tobytes()
    return out[: -out[-1]] if unpad and 1 <= out[-1] <= 16 else out


def aes_cbc_encrypt(key: bytes, data: bytes, iv: bytes) -> bytes:
    out, prev = bytearray(), iv
    for k in range(0, len(data), 16):
        prev = aes_blocks(key, bytes(a ^ b for a, b in zip(data[k : k + 16], prev, strict=True)), True).tobytes()
        out += prev
    return bytes(out)


def hash_2b(password: bytes, salt: bytes, user: bytes, revision: int) -> bytes:
    k = hashlib.sha256(password + salt + user).digest()
    if revision < 6:
        return k
    n = 0
    while True:
        e = aes_cbc_encrypt(k[:16], (password + k + user) * 64, k[16:32])
        k = (hashlib.sha256, hashlib.sha384, hashlib.sha512)[sum(e[:16]) % 3](e).digest()
        n += 1
        if n >= 64 and e[-1] <= n - 32:
            return k[:32]


class Decryptor:
    def __init__(self, enc: dict, first_id: bytes, password: bytes):
        """ValueError if the password opens neither as the user's nor as the owner's."""
        self.v, self.r = enc.get("V", 0), enc.get("R", 2)
        length = enc.get("Length", 40)
        length = length * 8 if length <= 32 else length
        self.n = 5 if self.v < 2 else max(5, min(16, length // 8))
        cf = enc.get("CF") if isinstance(enc.get("CF"), dict) else {}
        method = lambda k: str((cf.get(str(enc.get(k, "Identity"))) or {}).get("CFM", "None")) if str(enc.get(k, "Identity")) != "Identity" else "Identity"
        self.streams, self.strings = (method("StmF"), method("StrF")) if self.v >= 4 else ("V2", "V2")
        if self.v == 4:
            self.n = 16
        o, u, p = enc.get("O", b""), enc.get("U", b""), enc.get("P", 0) & 0xFFFFFFFF
        self.meta = enc.get("EncryptMetadata", True) is not False
        if self.r >= 5:
            self.key = self._modern(enc, o, u, password[:127])
        else:
            self.key = self._classic(password, o[:32], u, p, first_id) or self._classic(self._user_password(password, o[:32]), o[:32], u, p, first_id)
        if not self.key:
            raise ValueError("wrong password")

    def _classic(self, password: bytes, o: bytes, u: bytes, p: int, first_id: bytes) -> bytes | None:
        k = hashlib.md5((password + PAD)[:32] + o + p.to_bytes(4, "little") + first_id + (b"\xff" * 4 if self.r >= 4 and not self.meta else b"")).digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k[: self.n]).digest()
        k = k[: self.n]
        if self.r < 3:
            return k if rc4(k, PAD) == u[:32] else None
        x = rc4(k, hashlib.md5(PAD + first_id).digest())
        for i in range(1, 20):
            x = rc4(bytes(c ^ i for c in k), x)
        return k if x == u[:16] else None

    def _user_password(self, password: bytes, o: bytes) -> bytes:
        k = hashlib.md5((password + PAD)[:32]).digest()
        if self.r >= 3:
            for _ in range(50):
                k = hashlib.md5(k).digest()
        k = k[: self.n]
        for i in range(19 if self.r >= 3 else 0, -1, -1):
            o = rc4(bytes(c ^ i for c in k), o)
        return o

    def _modern(self, enc: dict, o: bytes, u: bytes, password: bytes) -> bytes | None:
        if hash_2b(password, u[32:40], b"", self.r) == u[:32]:
            return aes_cbc_decrypt(hash_2b(password, u[40:48], b"", self.r), enc.get("UE", b"")[:32], bytes(16), False)
        if hash_2b(password, o[32:40], u[:48], self.r) == o[:32]:
            return aes_cbc_decrypt(hash_2b(password, o[40:48], u[:48], self.r), enc.get("OE", b"")[:32], bytes(16), False)
        return None

    def bytes(self, data: bytes, num: int, gen: int, method: str) -> bytes:
        if method in ("Identity", "None"):
            return data
        if self.r >= 5:
            return aes_cbc_decrypt(self.key, data)
        aes = method == "AESV2"
        k = hashlib.md5(self.key + num.to_bytes(4, "little")[:3] + gen.to_bytes(4, "little")[:2] + (b"sAlT" if aes else b"")).digest()[: min(16, self.n + 5)]
        return aes_cbc_decrypt(k, data) if aes else rc4(k, data)

    def object(self, x, num: int, gen: int):
        if isinstance(x, bytes):
            return self.bytes(x, num, gen, self.strings)
        if isinstance(x, list):
            return [self.object(v, num, gen) for v in x]
        if isinstance(x, dict):
            return {k: self.object(v, num, gen) for k, v in x.items()}
        if isinstance(x, Stream):
            kind = x.attrs.get("Type")
            if kind == "XRef" or kind == "Metadata" and not self.meta:
                return x
            f = x.attrs.get("Filter")
            plain = f == "Crypt" or isinstance(f, list) and Name("Crypt") in f
            return Stream(self.object(x.attrs, num, gen), x.data if plain else self.bytes(x.data, num, gen, self.streams))
        return x
