"""Texts decoded with a wrong encoding: found and restored by noisy-channel decoding under corpus frequencies."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.llm.lost_signs import LOST, fill_lost, skeleton, split
from linkloom.runtime import cut, join_unique, spread

#: Encodings a text may have been read in by mistake, and single-byte encodings it may have been written in.
READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1250", "cp1251")
WRITTEN_IN = ("cp1252", "mac_roman", "cp850")
#: Encodings of two bytes a sign it may have been written in.
WRITTEN_WIDE = ("cp932", "euc_jp")
#: Log-odds of entering and of leaving a damaged span, and the most that words add to or take from a UTF-8 reading's signs.
SWITCH, WORDS_WEIGH = 2.0, 4.0
#: Log-odds against bytes being lost in a chunk, and for each further sign whose rest is taken as lost.
LOSS, LOSS_MORE = 4.0, 0.5
#: Log-odds of a sign that stands for lost bytes: no sound text holds it.
SURE = 50.0
#: Part of a count that an unseen form gets.
UNSEEN = 0.1
#: Distinct forms a task counts before it hands its counts on.
FLUSH = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")


def _bytes_of(encoding: str) -> dict[str, int]:
    """Sign to byte over the upper half; bytes the encoding lacks stand for the control sign of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


TO_BYTE = {e: _bytes_of(e) for e in READ_AS}
TO_SIGN = {e: {b: s for s, b in _bytes_of(e).items()} for e in WRITTEN_IN}


def _sequence_shape() -> re.Pattern[str]:
    """A lead byte and a byte that may follow it, as signs of one of READ_AS: what signs of wrong decodings look like."""
    cls = lambda e, a, b: "[" + "".join(re.escape(s) for s, x in TO_BYTE[e].items() if a <= x <= b) + "]"
    return re.compile("|".join(cls(e, 0xC2, 0xF4) + cls(e, 0x80, 0xBF) for e in READ_AS))


_SEQUENCE = _sequence_shape()
_LEADS = frozenset(s for e in READ_AS for s, x in TO_BYTE[e].items() if 0xC2 <= x <= 0xF4)


def _utf8_length(b: int | None) -> int:
    return 0 if b is None or not 0xC2 <= b <= 0xF4 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4


def undo_utf8(text: str, read_as: str) -> tuple[str, int, list[int]]:
    """(text with every valid UTF-8 sequence decoded, number of sequences, places of lead bytes whose rest is lost).

    The text's signs are taken back to bytes of ``read_as``; a lead byte with a lost rest is left as it is.
    """
    table, out, n, lost, i = TO_BYTE[read_as], [], 0, [], 0
    while i < len(text):
        lead = table.get(text[i])
        k = _utf8_length(lead)
        if k:
            rest = [table.get(s, 0) for s in text[i + 1 : i + k]]
            if len(rest) == k - 1 and all(0x80 <= x < 0xC0 for x in rest):
                try:
                    out.append(bytes([lead, *rest]).decode("utf-8"))
                    i, n = i + k, n + 1
                    continue
                except UnicodeDecodeError:
                    pass
            lost.append(len(out))
        out.append(text[i])
        i += 1
    return "".join(out), n, lost


def candidates(chunk: str) -> list[tuple[str, str, int]]:
    """(channel, reading, valid sequences) of the ways ``chunk`` may have arisen, the chunk itself aside.

    Lattice edges: a UTF-8 sequence read in one of READ_AS, repeatedly if it was garbled repeatedly; lead bytes whose rest is
    lost, each as a wildcard (the lost sign), a single one of two bytes also as each sign it may begin; signs lost already;
    each sign of one single-byte encoding read in another; signs of two bytes read as two.
    """
    found = []
    if LOST in chunk:
        found.append(("lost", chunk, 0))
    for e in READ_AS:
        text, n, lost = undo_utf8(chunk, e)
        sequences = n
        total, deeper = n, text
        while n:  # each turn shortens the text
            found.append((e, deeper, total))  # each depth is a reading: a further one may be chance
            deeper, n = max((undo_utf8(deeper, x)[:2] for x in READ_AS), key=lambda r: r[1])
            total += n
        if lost:
            signs_of = list(text)
            for i in lost:
                signs_of[i] = LOST
            found.append((e, "".join(signs_of), sequences))
        if len(lost) == 1 and (lead := TO_BYTE[e].get(text[lost[0]])) is not None and lead < 0xE0:
            head, tail = text[: lost[0]], text[lost[0] + 1 :]
            found += [(e, head + bytes([lead, x]).decode("utf-8") + tail, sequences) for x in range(0x80, 0xC0)]
    for read in READ_AS:
        table = TO_BYTE[read]
        if not all(s in table or s < "\x80" for s in chunk):
            continue
        for written in WRITTEN_IN if read != "latin-1" else ():
            if written != read:
                text = "".join(TO_SIGN[written][table[s]] if s >= "\x80" else s for s in chunk)
                if text != chunk and not any(unicodedata.category(s) == "Cc" for s in text):
                    found.append((f"{written}>{read}", text, 0))
        raw = bytes(table[s] if s >= "\x80" else ord(s) for s in chunk)
        for wide in WRITTEN_WIDE:
            try:
                text = raw.decode(wide)
            except UnicodeDecodeError:
                continue
            n = sum("\u3040" <= s <= "\u30ff" or "\u4e00" <= s <= "\u9fff" for s in text)
            if n > 1:
                found.append((f"{wide}>{read}", text, n))
    return list(dict.fromkeys(found))


def shape(chunk: str) -> str:
    """The form under which chunks are counted: composed, lower case, digits alike."""
    return _DIGIT.sub("0", unicodedata.normalize("NFC", chunk).lower())


def tokens(form: str) -> list[str]:
    """A form's words, and its signs beyond ASCII with the kinds of their neighbours."""
    out = ["w" + w for w in _LETTERS.findall(form)]
    kind = lambda s: "L" if s.isalpha() else "D" if s.isdigit() else "S"
    for i, s in enumerate(form):
        if s >= "\x80" and not s.isalpha():
            out.append("x" + (kind(form[i - 1]) if i else "^") + s + (kind(form[i + 1]) if i + 1 < len(form) else "$"))
    return out


def signs(text: str) -> list[str]:
    return ["h" + s for s in text if s >= "\x80" and s != LOST]


def log_likelihood(form: str, counts: dict[str, int], n: int) -> float:
    """Of a form: as a whole or as its parts, whichever is likelier; with lost signs, of all forms that fit."""
    p = lambda t: math.log((counts.get(t, 0) + UNSEEN) / n)
    if LOST in form:
        return p("s" + skeleton(form))
    parts = tokens(form)
    return max(p("c" + form), sum(map(p, parts)) if parts else p("c" + form))


def span_path(chunks: list[list[dict]]) -> list[dict | None]:
    """Viterbi over the chunks of a text: the channel under which each chunk is read, None for as it stands. Entering and
    leaving a channel costs SWITCH each, so evidence of one channel adds up over neighbouring chunks.
    """
    channels = sorted({c["channel"] for cs in chunks for c in cs})
    best: dict[str, float] = {"": 0.0} | dict.fromkeys(channels, -SWITCH)
    back: list[dict[str, str]] = []
    for cs in chunks:
        gains = {c["channel"]: c["gain"] for c in cs}
        came, new = {}, {}
        top = max(channels, key=lambda c: best[c]) if channels else ""
        for s in ("", *channels):
            stay = best[s]
            if s == "":
                move, frm = (best[top] - SWITCH, top) if channels else (-math.inf, "")
            else:
                move, frm = best[""] - SWITCH, ""
            came[s], x = (s, stay) if stay >= move else (frm, move)
            new[s] = x + (gains.get(s, 0.0) if s else 0.0)
        back.append(came)
        best = new
    for c in channels:
        best[c] -= SWITCH
    state = max(best, key=lambda s: (best[s], s == ""))
    out: list[dict | None] = []
    for cs, came in zip(reversed(chunks), reversed(back)):
        out.append(next((c for c in cs if c["channel"] == state), None) if state else None)
        state = came[state]
    return out[::-1]


_SCAN = "kind string, form string, n bigint, doc_id bigint, pos int"
_SCAN_ARROW = pa.schema([("kind", pa.string()), ("form", pa.string()), ("n", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCAN_ARROW)], schema=_SCAN_ARROW)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts (kind t: words, signs in context, whole non-ASCII forms and their skeletons) and places of non-ASCII chunks (kind o).
    Chunks that look like wrong decodings are counted apart (g): they speak for themselves, but for no other chunk's reading.
    """
    seen: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        counts: Counter[str] = Counter()
        for chunk, n in seen.items():
            form, mark = shape(chunk), ""
            if not chunk.isascii():
                mark = "g" if LOST in chunk or _SEQUENCE.search(chunk) else ""  # not evidence of what is sound
                counts[mark + "c" + form] += n
                counts[mark + "s" + skeleton(form)] += n
                for t in signs(chunk):
                    counts[mark + t] += n
            for t in tokens(form):
                counts[mark + t] += n
        seen.clear()
        return _batch([("t", t, n, None, None) for t, n in counts.items()])

    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            chunks = split(text)
            seen.update(chunks)
            if not text.isascii():
                rows += [("o", c, 1, doc_id, i) for i, c in enumerate(chunks) if not c.isascii()]
        if rows:
            yield _batch(rows)
        if len(seen) > FLUSH:
            yield flush()
    if seen:
        yield flush()


def needed(text: str, wild: bool) -> set[str]:
    """The counts a text's likelihood asks for."""
    form = shape(text)
    return {"s" + skeleton(form)} if wild and LOST in form else {"c" + form, *tokens(form), *signs(text)}


_NEEDS = "raw string, token string"


def _needs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws, toks = [], []
        for raw in b.column("raw").to_pylist():
            need = needed(raw, False)
            need |= {"g" + t for t in need}
            for c in candidates(raw):
                need |= needed(c[1], True)
            raws += [raw] * len(need)
            toks += need
        yield pa.RecordBatch.from_arrays([pa.array(raws, pa.string()), pa.array(toks, pa.string())], ["raw", "token"])


_READING = pa.struct([("channel", pa.string()), ("text", pa.string()), ("gain", pa.float64())])


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raws, out = [], []
        for raw, known, total in zip(*(b.column(c).to_pylist() for c in ("raw", "known", "total"))):
            counts = {k["token"]: k["n"] for k in known or ()}
            own_counts = Counter(counts)
            for t, k in counts.items():
                if t[0] == "g":
                    own_counts[t[1:]] += k
            n = float(total)
            p = lambda text, seen: sum(math.log((seen.get(t, 0) + UNSEEN) / n) for t in signs(text))
            own = log_likelihood(shape(raw), own_counts, n) if LOST not in raw else 0.0
            for t in {"c" + shape(raw), *tokens(shape(raw))}:
                own_counts[t] = max(0, own_counts[t] - 1)
            alone = log_likelihood(shape(raw), own_counts, n) if LOST not in raw else 0.0  # but for this occurrence
            own_signs, best = p(raw, own_counts), {}
            for channel, text, sequences in candidates(raw):
                if channel == "lost":
                    best[channel] = {"channel": channel, "text": text, "gain": SURE}
                    continue
                wild = text.count(LOST) - raw.count(LOST)
                if wild and not any(s.isalnum() and s != LOST for s in text):
                    continue  # nothing is left that a known form could fit
                if wild and not sequences:
                    # forms that fit, the chunk itself apart
                    others = counts.get("s" + skeleton(shape(text)), 0) - (counts.get("c" + shape(raw), 0) if skeleton(shape(raw)) == skeleton(shape(text)) else 0)
                    gain = math.log((max(others, 0) + UNSEEN) / n) - alone - LOSS - LOSS_MORE * (wild - 1)
                    if channel not in best or gain > best[channel]["gain"]:
                        best[channel] = {"channel": channel, "text": text, "gain": gain}
                    continue
                if channel.split(">")[0] in WRITTEN_WIDE and not all(counts.get(t) for t in signs(text)):
                    continue  # signs that no sound text holds are chance
                gain = log_likelihood(shape(text), counts, n) - own
                if wild:
                    # what is lost can't speak for the reading: neither its signs nor the whole form
                    before, _, lost = undo_utf8(raw, channel)
                    gain = p(text, counts) - own_signs + p("".join(before[i] for i in lost), own_counts) - LOSS - LOSS_MORE * (wild - 1)
                elif sequences:
                    gain = p(text, counts) - own_signs + max(-WORDS_WEIGH, min(WORDS_WEIGH, gain))
                elif ">" not in channel or len(raw) == 1:
                    gain /= 2  # a guess at lost bytes and a sign on its own need support by their neighbours
                if LOST in raw:
                    gain += SURE
                if channel not in best or gain > best[channel]["gain"]:
                    best[channel] = {"channel": channel, "text": text, "gain": gain}
            raws.append(raw)
            out.append(list(best.values()))
        yield pa.RecordBatch.from_arrays([pa.array(raws, pa.string()), pa.array(out, pa.list_(_READING))], ["raw", "readings"])


_FIX = pa.struct([("pos", pa.int32()), ("text", pa.string())])


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, fixes = [], []
        for doc_id, chunks in zip(b.column("doc_id").to_pylist(), b.column("chunks").to_pylist()):
            chunks.sort(key=lambda c: c["pos"])
            path = span_path([c["readings"] or [] for c in chunks])
            fix = []
            for c, r in zip(chunks, path):
                if r and (r["text"] != c["raw"] or r["channel"] == "lost"):
                    fix.append({"pos": c["pos"], "text": r["text"]})
            if fix:
                ids.append(doc_id)
                fixes.append(fix)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(fixes, pa.list_(_FIX))], ["doc_id", "fixes"])


def damaged_chunks(documents: DataFrame) -> DataFrame:
    """(doc_id, fixes): of each document with damage, the places of its damaged chunks (runs between white space) and their
    restored text, in which lost signs still stand (see fill_lost). Every chunk takes its reading from the path.

    Frequencies are counted over all documents and joined to the readings of the distinct suspect chunks; documents meet
    readings by chunk. Nothing that grows with the documents is broadcast or collected.
    """
    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    scan = cut(rows.mapInArrow(_scan, _SCAN))
    places = scan.where("kind = 'o'").select("doc_id", "pos", F.col("form").alias("raw"))
    counts = cut(scan.where("kind = 't'").groupBy("form").agg(F.sum("n").alias("n")))
    raws = cut(places.groupBy("raw").agg(F.count(F.lit(1)).alias("n")))
    total = counts.where("form like 'w%'").agg(F.greatest(F.sum("n"), F.lit(1)).alias("total"))
    needs = cut(spread(raws.select("raw")).mapInArrow(_needs, _NEEDS))
    known = join_unique(needs, counts.withColumnRenamed("form", "token"), ["token"], "left").groupBy("raw").agg(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("token", "n"))).alias("known"))
    readings = known.crossJoin(F.broadcast(total)).mapInArrow(_readings, "raw string, readings array<struct<channel:string,text:string,gain:double>>")  # total: one row

    scored = cut(readings)
    suspect = scored.where(F.exists("readings", lambda r: r["gain"] > 0)).select("raw")
    docs = cut(join_unique(places.select("doc_id", "raw"), suspect, ["raw"], "left_semi").select("doc_id").distinct())
    inside = places.join(docs, "doc_id", "left_semi")
    texts = join_unique(inside, scored, ["raw"]).groupBy("doc_id").agg(F.collect_list(F.struct("pos", "raw", "readings")).alias("chunks"))  # one document's chunks
    return texts.mapInArrow(_decode, "doc_id bigint, fixes array<struct<pos:int,text:string>>")


def _patch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, fixes in zip(b.column("text").to_pylist(), b.column("fixes").to_pylist()):
            parts = re.split(r"([ \t\r\n]+)" if "\t" in text or "\r" in text or "\n" in text else "( )", text)
            for f in fixes:
                parts[2 * f["pos"]] = f["text"]
            out.append("".join(parts))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), pa.array([len(f) for f in b.column("fixes").to_pylist()], pa.int32())], ["doc_id", "restored", "n_fixes"])


def restore_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, restored, n_fixes) of every document that holds garbled signs, restorable or not.

    Sound but unusual signs and decomposed accents are left alone: a reading replaces a chunk only where the corpus, or the
    structure of UTF-8, makes it clearly likelier, alone or together with its neighbours. Lost signs are filled by fill_lost;
    chunks whose lost signs no known form fills stay as they are. Null and empty texts hold none;
    an empty table gives no rows. doc_id is taken as unique; extra columns are ignored.
    """
    fixes = cut(damaged_chunks(documents))
    found = fixes.select("doc_id", F.explode("fixes").alias("f")).select("doc_id", "f.pos", "f.text")
    filled = fill_lost(documents, fixes).withColumnRenamed("text", "filled")
    whole = found.join(filled, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("filled", "text").alias("text"))
    fixes = cut(whole.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "text")).alias("fixes")))  # one document's chunks
    return documents.where("text is not null").select("doc_id", "text").join(fixes, "doc_id").mapInArrow(_patch, "doc_id bigint, restored string, n_fixes int")
