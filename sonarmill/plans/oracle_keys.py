"""The key rules of ``functions.keys`` as DuckDB SQL, in another formulation, for the oracle queries."""

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11) || chr(160)"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def split_name(c: str) -> str:
    return f"CASE left(lower({strip(c)}), 3) WHEN 'tra' THEN 'train' WHEN 'val' THEN 'validation' WHEN 'tes' THEN 'test' END"


def group_key(c: str) -> str:
    return f"nullif(lower({strip(c)}), '')"


def source_key(c: str) -> str:
    return f"nullif(replace(lower({strip(c)}), '-', '_'), '')"


def sha_key(c: str) -> str:
    return f"nullif({strip(f'''regexp_replace(lower({strip(c)}), '^sha256:', '')''')}, '')"


def segment_key(c: str) -> str:
    return f"nullif(regexp_replace(replace(lower({strip(c)}), '_', ':'), ':0+([0-9]+)$', ':\\1'), '')"


def path_key(c: str) -> str:
    steps = f"list_filter(string_split(replace({strip(c)}, '\\', '/'), '/'), lambda x: x NOT IN ('', '.'))"
    first = f"list_min(list_transform(['segments', 'features', 'raw'], lambda r: nullif(list_position({steps}, r), 0)))"
    return f"nullif(array_to_string(list_slice({steps}, coalesce({first}, 1), len({steps})), '/'), '')"
