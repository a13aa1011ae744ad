"""Expected rows of the fixed tables, written out by hand for DuckDB, apart from the tables of ``plans``."""

#: Fixed values.
FORMATS = """
select * from (values
  ('svg', 'svg', 'svg,svgz', 'image/svg+xml', true, false, true, false, 256),
  ('pdf', 'pdf', 'pdf', 'application/pdf', true, false, true, true, 10),
  ('tiff', 'tiff', 'tif,tiff', 'image/tiff', true, false, true, true, 4),
  ('jp2', 'jp2', 'jp2,j2k', 'image/jp2', true, false, true, true, 12)
) v(format, extension, extensions, mime, alpha, animation, lossless, lossy, bytes_needed)
"""

#: Rows are flags, columns operations.
CAPABILITIES = """
with m as (select * from (values
  ('cheap_probe', 1, 0, 1, 1, 1), ('icc', 1, 1, 0, 0, 1), ('exif', 1, 1, 0, 0, 0), ('xmp', 1, 1, 0, 0, 0),
  ('stop', 1, 1, 1, 0, 0), ('gray', 1, 1, 0, 0, 1), ('bits16', 1, 1, 0, 0, 0), ('f32', 1, 1, 0, 0, 0),
  ('alpha', 1, 1, 1, 1, 1), ('hdr', 1, 0, 0, 0, 0), ('lossless', 0, 1, 0, 0, 0), ('multi_image', 1, 0, 0, 0, 0),
  ('max_pixels', 1, 1, 1, 1, 1), ('max_memory', 1, 0, 1, 0, 1), ('max_input', 0, 0, 1, 1, 0)
) v(flag, tiff_decode, tiff_encode, svg, pdf, jp2))
select operation, flag from (unpivot m on tiff_decode, tiff_encode, svg, pdf, jp2 into name operation value has) where has = 1
"""

#: Number, codec, origin and kind of each error.
ERRORS = """(values
  (0, 'tiff', 'Image', 'Malformed'), (1, 'tiff', 'Internal', 'Dependency'), (2, 'tiff', 'Image', 'UnexpectedEof'),
  (3, 'tiff', 'Request', 'Invalid(Parameters)'), (4, 'tiff', 'Image', 'Unsupported(Feature)'), (5, 'tiff', 'Request', 'Unsupported'),
  (6, 'tiff', 'Image', 'Malformed'), (7, 'tiff', 'Resource', 'OutOfMemory'), (8, 'tiff', 'Resource', 'Limits'),
  (9, 'tiff', 'Stopped', 'Stopped'), (10, 'tiff', 'Io', 'Io'), (11, 'tiff', 'Request', 'Invalid(Buffer)'),
  (12, 'svg', 'Image', 'Malformed'), (13, 'svg', 'Resource', 'Limits(Scans)'), (14, 'svg', 'Image', 'Unsupported(Type)'),
  (15, 'svg', 'Request', 'Invalid(Parameters)'), (16, 'svg', 'Resource', 'OutOfMemory'), (17, 'svg', 'Resource', 'OutOfMemory'),
  (18, 'svg', 'Internal', 'Bug'), (19, 'svg', 'Resource', 'Limits'), (20, 'svg', 'Request', 'Unsupported'),
  (21, 'svg', 'Stopped', 'Stopped'), (22, 'svg', 'Resource', 'Limits(DecompressionRatio)'), (23, 'svg', 'Internal', 'Dependency'),
  (24, 'svg', 'Internal', 'Dependency'), (25, 'svg', 'Io', 'Io'),
  (26, 'pdf', 'Image', 'Malformed'), (27, 'pdf', 'Image', 'Unsupported(Feature)'), (28, 'pdf', 'Request', 'Invalid(Parameters)'),
  (29, 'pdf', 'Request', 'Invalid(Parameters)'), (30, 'pdf', 'Request', 'Invalid(Parameters)'), (31, 'pdf', 'Image', 'Malformed'),
  (32, 'pdf', 'Resource', 'Limits(Frames)'), (33, 'pdf', 'Resource', 'Limits(Pixels)'), (34, 'pdf', 'Resource', 'OutOfMemory'),
  (35, 'pdf', 'Request', 'Unsupported'), (36, 'pdf', 'Resource', 'Limits'), (37, 'pdf', 'Io', 'Io'),
  (38, 'jp2', 'Image', 'UnexpectedEof'), (39, 'jp2', 'Image', 'Unsupported(Type)'), (40, 'jp2', 'Image', 'Unsupported(Feature)'),
  (41, 'jp2', 'Image', 'Malformed'), (42, 'jp2', 'Internal', 'Bug'), (43, 'jp2', 'Resource', 'OutOfMemory'),
  (44, 'jp2', 'Request', 'Unsupported'), (45, 'jp2', 'Resource', 'Limits'), (46, 'jp2', 'Io', 'Io')
) v(variant_id, codec, origin, kind)"""

#: The methods, their codes and cost tiers; fingerprints are FNV-1a of code, predictor and layout.
VARIANTS = """
with c as (
  select *, (ci > 0)::int + p + b as deviations, ci + p + b as idx_sum
  from (values (0, 'none', 0, 0), (1, 'lzw', 1, 2), (2, 'deflate', 2, 3), (3, 'packbits', 3, 1)) m(ci, method, code, tier), range(2) x(p), range(2) y(b)
  where ci > 0 or p = 0
), h as (select *, (xor(14695981039346656037::hugeint, code::hugeint) * 1099511628211) % 18446744073709551616 as h1 from c),
i as (select *, (xor(h1, p::hugeint) * 1099511628211) % 18446744073709551616 as h2 from h),
j as (select *, (xor(h2, b::hugeint) * 1099511628211) % 18446744073709551616 as h3 from i)
select 'tiff-' || method || case when p = 1 then '-hpred' else '' end || case when b = 1 then '-big' else '' end as cell_id,
  cast(deviations as int) as deviations, cast(idx_sum as int) as idx_sum, tier, lower(lpad(to_hex(h3::ubigint), 16, '0')) as fingerprint, tier > 2 as dropped
from j where tier > 2 or deviations <= 2
"""

#: Fixed values.
DESCRIPTORS = """
select 'tiff' as codec, direction, channels || '_' || sample as descriptor
from (values ('decode'), ('encode')) d(direction), (values ('gray'), ('graya'), ('rgb'), ('rgba')) c(channels), (values ('u8'), ('u16'), ('f32')) s(sample)
union all select * from (values ('svg', 'decode', 'rgba_u8'), ('pdf', 'decode', 'rgba_u8'), ('jp2', 'decode', 'rgb_u8'), ('jp2', 'decode', 'rgba_u8'), ('jp2', 'decode', 'gray_u8')) v
"""

#: Fixed values.
SOURCES = "select * from (values ('tiff', true, cast(null as float)), ('jp2', false, cast(null as float))) v(codec, lossless, quality)"

#: Fixed values.
COMPRESSIONS = """
select compression, code, compression in ('none', 'lzw', 'deflate', 'old_deflate', 'packbits') as readable
from (values ('none', 1), ('fax', 3), ('fax4', 4), ('lzw', 5), ('jpeg', 7), ('deflate', 8), ('packbits', 32773), ('old_deflate', 32946), ('zstd', 50000), ('webp', 50001)) v(compression, code)
"""

#: Fixed values.
REFUSED = """
select codec, operation from (values ('tiff'), ('svg'), ('pdf'), ('jp2')) c(codec), (values ('row_level_decode'), ('animation_decode')) o(operation)
union all select 'tiff', 'animation_encode'
"""
