"""Leaf payloads of render assets: built from keyframes, laid out, checked and read, in Spark's own functions over binary columns.

A payload is a header word, two key counts, a coarse stream and, by mode, a fine stream or
a shell: which voxels are occupied, and a stream of their residuals. A stream has a
descriptor for each control, bin hints and keyframes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bits

# fixed values of the format
EMPTY, COARSE, SHELL, FINE = 0, 1, 2, 3
HALF, SINGLE = 0, 1
KEY_BYTES = {HALF: 3, SINGLE: 8}
DESCRIPTOR_BYTES, BINS, SHELL_BINS, MASK_BYTES, SHELL_BYTES, HEAD_BYTES = 4, 8, 4, 64, 80, 8
ERRORS = ("leaf bytes too small", "leaf prefix missing", "leaf shorter than computed layout", "shell group prefix is inconsistent", "shell mode contains no active voxels", "shell residual stream is out of bounds", "shell leaf contains trailing bytes")


def _u(at: str, n: int, of: str = "payload") -> str:
    """The unsigned number of n bytes, lowest first, behind an offset of a binary."""
    each = ", ".join(f"hex(substring({of}, cast({at} as int) + {i + 1}, 1))" for i in reversed(range(n)))
    return f"cast(conv(concat({each}), 16, 10) as bigint)"


def _up(x: str) -> str:
    return f"(({x}) + 3) div 4 * 4"


def _keys(count: str, codec: str) -> str:
    return f"({count}) * if({codec} = {SINGLE}, {KEY_BYTES[SINGLE]}, {KEY_BYTES[HALF]})"


def with_head(leaves: DataFrame) -> DataFrame:
    """leaves (payload, ...) with n_bytes, mode, codecs and resolutions from the header word, null where there is none."""
    out = leaves.withColumn("n_bytes", F.octet_length("payload")).withColumn("word", F.expr(f"if(n_bytes >= 4, {_u('0', 4)}, null)"))
    field = lambda shift, n: bits.unpacked(F.col("word"), shift, n).cast("int")
    return out.withColumns({"mode": field(0, 2), "coarse_codec": field(2, 2), "fine_codec": field(4, 2), "coarse_resolution": field(6, 3), "fine_resolution": field(9, 3)}).drop("word")


def laid_out(leaves: DataFrame) -> DataFrame:
    """leaves (payload, ...) with the header's fields, where each part lies, total (bytes that the layout needs), active (occupied voxels of a shell), prefix_fits (no keys without controls) and error, null for a sound leaf.

    Errors are those of ERRORS, the first that applies; fields of a leaf that is too short are null or 0.
    """
    e, out = F.expr, with_head(leaves)
    there = f"mode <> {EMPTY} and n_bytes >= {HEAD_BYTES}"
    out = out.withColumns({"coarse_keys": e(f"if({there}, {_u('4', 2)}, 0)"), "fine_keys": e(f"if({there}, {_u('6', 2)}, 0)"), "coarse_controls": e("pow(coarse_resolution, 3)").cast("int"), "fine_controls": e("pow(fine_resolution, 3)").cast("int")})
    out = out.withColumn("coarse_at", F.lit(HEAD_BYTES)).withColumn("coarse_bins_at", e(f"coarse_at + {DESCRIPTOR_BYTES} * coarse_controls"))
    out = out.withColumn("coarse_keys_at", e(f"coarse_bins_at + {_up(f'{BINS} * coarse_controls')}")).withColumn("fine_at", e(f"coarse_keys_at + {_up(_keys('coarse_keys', 'coarse_codec'))}"))
    fine_keys = _up(_keys("fine_keys", "fine_codec"))
    out = out.withColumn("total", e(f"case mode when {EMPTY} then 4 when {FINE} then fine_at + {DESCRIPTOR_BYTES} * fine_controls + {_up(f'{BINS} * fine_controls')} + {fine_keys} when {SHELL} then fine_at + {SHELL_BYTES} + {fine_keys} else fine_at end"))
    shell = f"mode = {SHELL} and n_bytes >= total"
    group = f"transform(sequence(0, 7), g -> bit_count({_u('fine_at + 8 * g', 4)}) + bit_count({_u('fine_at + 8 * g + 4', 4)}))"
    out = out.withColumns({"held": e(f"if({shell}, {group}, null)"), "prefixes": e(f"if({shell}, transform(sequence(0, 7), g -> {_u(f'fine_at + {MASK_BYTES} + 2 * g', 2)}), null)")})
    out = out.withColumns({"active": e("aggregate(held, 0, (s, x) -> s + x)"), "before": e("transform(sequence(0, 7), g -> aggregate(slice(held, 1, g), 0, (s, x) -> s + x))")})
    out = out.withColumn("shell_at", e(_up(f"fine_at + {SHELL_BYTES}"))).withColumn("shell_end", e(f"shell_at + {DESCRIPTOR_BYTES} * active + {_up(f'{SHELL_BINS} * active')} + {fine_keys}"))
    fits = e(f"not ((coarse_controls = 0 and coarse_keys > 0) or (mode in ({SHELL}, {FINE}) and fine_controls = 0 and fine_keys > 0))")
    tests = ["n_bytes < 4", f"mode <> {EMPTY} and n_bytes < {HEAD_BYTES}", f"mode <> {EMPTY} and total > n_bytes"]
    tests += [f"mode = {SHELL} and {t}" for t in ("exists(zip_with(prefixes, before, (p, b) -> p = b), x -> not x)", "active = 0", "shell_end > n_bytes", "shell_end <> n_bytes")]
    error = e("case " + " ".join(f"when {t} then '{name}'" for t, name in zip(tests, ERRORS, strict=True)) + " end")
    return out.withColumns({"prefix_fits": fits, "error": error}).drop("held", "prefixes", "before")


def _float(word: str, signs: int, mantissas: int, bias: int) -> str:
    """The value of a float's bits (no infinities): its sign bit's place, how many mantissas an exponent has, and the power of two of the last one."""
    exponent, mantissa = f"({word} % {signs} div {mantissas})", f"({word} % {mantissas})"
    return f"if({word} >= {signs}, -1D, 1D) * if({exponent} = 0, {mantissa} * pow(2D, {1 - bias}), ({mantissas} + {mantissa}) * pow(2D, {exponent} - {bias}))"


def _range(n: str) -> str:
    return f"if({n} > 0, sequence(0, cast({n} as int) - 1), array())"


def series_of(leaves: DataFrame) -> DataFrame:
    """(leaf_id, stream, control, keys, broken): each control's keyframes (t, v) of leaves (leaf_id, laid_out columns) without error, by stream coarse, fine or shell; a shell's control is the voxel.

    broken: the descriptor names keys beyond the stream's; keys is null then. A control's own bytes are cut out inside the leaf's row, so payloads are not multiplied.
    """
    occupied = f"filter(sequence(0, 511), v -> shiftright({_u('fine_at + v div 8', 1)}, v % 8) & 1 = 1)"
    rows = leaves.where(f"error is null and mode <> {EMPTY}").withColumn("voxels", F.expr(f"if(mode = {SHELL}, {occupied}, array())"))
    bins = {"fine": f"fine_at + {DESCRIPTOR_BYTES} * fine_controls", "shell": f"shell_at + {DESCRIPTOR_BYTES} * active"}
    streams = {
        "coarse": ("coarse_at", "coarse_controls", "coarse_keys_at", "coarse_keys", "coarse_codec"),
        "fine": ("fine_at", f"if(mode = {FINE}, fine_controls, 0)", f"{bins['fine']} + {_up(f'{BINS} * fine_controls')}", "fine_keys", "fine_codec"),
        "shell": ("shell_at", f"if(mode = {SHELL}, active, 0)", f"{bins['shell']} + {_up(f'{SHELL_BINS} * active')}", "fine_keys", "fine_codec"),
    }
    cut = lambda at, n: f"substring(payload, cast({at} as int) + 1, cast({n} as int))"
    parts = [
        f"named_struct('stream', '{name}', 'controls', cast({n} as int), 'descriptors', {cut(at, f'{DESCRIPTOR_BYTES} * {n}')}, 'block', {cut(keys_at, _keys(count, codec))}, 'count', {count}, 'key_bytes', {_keys('1', codec)})"
        for name, (at, n, keys_at, count, codec) in streams.items()
    ]
    each = rows.select("leaf_id", "voxels", F.explode(F.expr(f"array({', '.join(parts)})")).alias("s")).select("leaf_id", "voxels", "s.*")
    own = "substring(block, cast(d.start * key_bytes as int) + 1, cast(d.held * key_bytes as int))"
    told = f"transform({_range('controls')}, c -> named_struct('c', c, 'start', {_u(f'{DESCRIPTOR_BYTES} * c', 2, 'descriptors')}, 'held', {_u(f'{DESCRIPTOR_BYTES} * c + 2', 1, 'descriptors')}))"
    controls = F.explode(F.expr(f"transform(told, d -> named_struct('control', if(stream = 'shell', get(voxels, d.c), d.c), 'held', d.held, 'broken', d.start + d.held > count, 'own', {own}))")).alias("d")
    each = each.withColumn("told", F.expr(told)).select("leaf_id", "stream", "key_bytes", controls).select("leaf_id", "stream", "key_bytes", "d.*")
    single = f"transform({_range('held')}, i -> named_struct('t', {_u('8 * i', 2, 'own')}, 'w', {_u('8 * i + 4', 4, 'own')}))"
    half = f"transform({_range('held')}, i -> named_struct('t', {_u('3 * i', 1, 'own')}, 'w', {_u('3 * i + 1', 2, 'own')}))"
    words = each.withColumn("words", F.expr(f"if(broken, null, if(key_bytes = {KEY_BYTES[SINGLE]}, {single}, {half}))"))
    value = f"if(key_bytes = {KEY_BYTES[SINGLE]}, {_float('k.w', 1 << 31, 1 << 23, 150)}, {_float('k.w', 1 << 15, 1 << 10, 25)})"
    return words.select("leaf_id", "stream", "control", F.expr(f"transform(words, k -> named_struct('t', k.t, 'v', {value}))").alias("keys"), "broken")


def _hex(value: Column, n: int) -> Column:
    """n bytes of a number as hex digits, lowest first."""
    return F.concat(*[F.lpad(F.hex(bits.unpacked(value, 8 * i, 8)), 2, "0") for i in range(n)])


def single_bits(v: Column) -> Column:
    """The bits of a value that a single float holds exactly."""
    size = F.abs(v)
    e = F.floor(F.log2(F.greatest(size, F.lit(2.0**-126))))
    e = F.when(size < F.pow(F.lit(2.0), e), e - 1).when(size >= F.pow(F.lit(2.0), e + 1), e + 1).otherwise(e)
    word = (e + 127) * (1 << 23) + (size / F.pow(F.lit(2.0), e) - 1) * (1 << 23)
    return (F.when(size > 0, word).otherwise(0) + F.when(v < 0, 1 << 31).otherwise(0)).cast("long")


def built(heads: DataFrame, keys: DataFrame, frames: int) -> DataFrame:
    """(leaf_id, payload) of heads (leaf_id, mode, coarse_codec, fine_codec, coarse_resolution, fine_resolution) and keys (leaf_id, stream, control, t, v), a shell's control being the voxel.

    Values are rounded to the stream's codec (single floats must be exact). Controls without keys get an empty descriptor. One
    leaf's keys meet in one row: their number is bounded by the leaf and the frames.
    """
    codec = F.when(F.col("stream") == "coarse", F.col("coarse_codec")).otherwise(F.col("fine_codec"))
    rows = keys.join(heads, "leaf_id").withColumn("codec", codec)
    packed = F.when(F.col("codec") == SINGLE, F.concat(_hex(F.col("t"), 2), F.lit("0000"), _hex(single_bits(F.col("v")), 4))).otherwise(F.concat(_hex(F.col("t"), 1), _hex(bits.half_bits(F.col("v")), 2)))
    series = rows.groupBy("leaf_id", "stream", "control").agg(F.array_sort(F.collect_list(F.struct("t", packed.alias("h")))).alias("keys"))
    bins = F.when(F.col("stream") == "shell", SHELL_BINS).otherwise(BINS)
    hint = F.expr(f"transform(sequence(0, bins - 1), b -> lpad(hex(greatest(0, size(filter(keys, k -> k.t <= ceil(b * {frames} / bins))) - 1)), 2, '0'))")
    series = series.withColumn("bins", bins).select("leaf_id", "stream", "control", F.size("keys").alias("n"), F.array_join(hint, "").alias("hints"), F.array_join(F.expr("transform(keys, k -> k.h)"), "").alias("hex"))
    held = series.groupBy("leaf_id").pivot("stream", ["coarse", "fine", "shell"]).agg(F.array_sort(F.collect_list(F.struct("control", "n", "hints", "hex"))))
    out = heads.join(held, "leaf_id", "left")
    word = bits.packed([(F.col(c), s, n) for c, s, n in (("mode", 0, 2), ("coarse_codec", 2, 2), ("fine_codec", 4, 2), ("coarse_resolution", 6, 3), ("fine_resolution", 9, 3))])
    empty = "named_struct('control', 0, 'n', 0, 'hints', '{}', 'hex', '')"

    def whole(name: str, controls: str, n_bins: int) -> str:
        """The stream's list with an entry for every control."""
        return f"transform({_range(controls)}, c -> coalesce(get(filter(coalesce({name}, array()), s -> s.control = c), 0), {empty.format('00' * n_bins)}))"

    out = out.withColumns({"coarse": F.expr(whole("coarse", "pow(coarse_resolution, 3)", BINS)), "fine": F.expr(whole("fine", f"if(mode = {FINE}, pow(fine_resolution, 3), 0)", BINS)), "shell": F.expr(f"if(mode = {SHELL}, coalesce(shell, array()), array())")})
    le2 = lambda x: f"concat(lpad(hex(({x}) % 256), 2, '0'), lpad(hex(({x}) div 256), 2, '0'))"
    total = lambda s: f"aggregate({s}, 0, (a, x) -> a + x.n)"
    pad = lambda h: f"rpad({h}, cast({_up(f'length({h}) div 2')} * 2 as int), '0')"

    def stream(s: str) -> str:
        descriptors = f"array_join(transform({s}, (x, i) -> concat({le2(total(f'slice({s}, 1, i)'))}, lpad(hex(x.n), 2, '0'), '00')), '')"
        return f"concat({descriptors}, {pad(f'''array_join(transform({s}, x -> x.hints), '')''')}, {pad(f'''array_join(transform({s}, x -> x.hex), '')''')})"

    in_group = "size(filter(shell, x -> x.control < 64 * g))"
    byte = "aggregate(filter(shell, x -> x.control div 8 = b), 0, (a, x) -> a + cast(pow(2, x.control % 8) as int))"
    mask = f"concat(array_join(transform(sequence(0, 63), b -> lpad(hex({byte}), 2, '0')), ''), array_join(transform(sequence(0, 7), g -> {le2(in_group)}), ''))"
    body = F.expr(f"concat({le2(total('coarse'))}, {le2(f'if(mode = {FINE}, {total("fine")}, {total("shell")})')}, {stream('coarse')}, case mode when {FINE} then {stream('fine')} when {SHELL} then concat({mask}, {stream('shell')}) else '' end)")
    return out.select("leaf_id", F.unhex(F.concat(_hex(word, 4), F.when(F.col("mode") == EMPTY, "").otherwise(body))).alias("payload"))
