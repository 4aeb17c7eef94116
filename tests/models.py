"""Plain Python models of the rules, for random comparison. Written for the tests; used nowhere else."""

import random
import re

HEX24 = "[0-9A-F]{24}"


def rows(df):
    """All rows of a small result, in a fixed order."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


def classify(path_prefix, key):
    for area in ("basebackups_005/", "wal_005/"):
        root = path_prefix + area
        if key.startswith(root):
            parts = key[len(root):].split("/")
            break
    else:
        return None
    if area.startswith("base"):
        if len(parts) == 1 and re.match(f"base_{HEX24}_[0-9A-F]{{8}}_backup_stop_sentinel\\.json", parts[0]):
            return "sentinel", parts[0][13:29]
        if len(parts) == 2 and re.match(f"base_{HEX24}_[0-9A-F]{{8}}", parts[0]) and parts[1] == "extended_version.txt":
            return "version", parts[0][13:29]
        if len(parts) == 3 and re.match(f"base_{HEX24}_[0-9A-F]{{8}}", parts[0]) and parts[1] == "tar_partitions":
            return "volume", parts[0][13:29]
        return "unexpected", None
    if len(parts) == 1:
        if re.match(HEX24 + r"\.lzo", parts[0]):
            return "segment", parts[0][8:24]
        if re.match(HEX24 + r"\.[A-F0-9]{8}.backup.lzo", parts[0]):
            return "label", parts[0][8:24]
        if re.match(r"[A-F0-9]{8}\.history", parts[0]):
            return "history", None
    return "unexpected", None


def segment(rng, logs=2, timelines=2):
    return f"{rng.randint(1, timelines):08X}{rng.randrange(logs):08X}{rng.randrange(256):08X}"


def random_key(rng, root):
    s = segment(rng)
    off = f"{rng.randrange(3):08X}"
    b = f"{root}basebackups_005/base_{s}_{off}"
    w = f"{root}wal_005/"
    return rng.choice([
        f"{b}_backup_stop_sentinel.json",
        f"{b}_backup_stop_sentinel.json.tmp",
        f"{b}/extended_version.txt",
        f"{b}/extended_version.txt2",
        f"{b}/tar_partitions/part_0000000{rng.randrange(3)}.tar.lzo",
        f"{b}/tar_partitions/odd",
        f"{b}/other/part_00000000.tar.lzo",
        f"{b}x/tar_partitions/a/b",
        f"{b}_partial.json",
        f"{w}{s}.lzo",
        f"{w}{s}.lzo",
        f"{w}{s}.lzo.tmp",
        f"{w}{s}.{off}.backup.lzo",
        f"{w}{s}.{off}xbackupylzo",
        f"{w}{s}.{off}/backup.lzo",
        f"{w}{s[:8]}.history.lzo",
        f"{w}sub/{s}.lzo",
        f"{w}{s.lower()}x.lzo",
        f"{root}elsewhere/{s}.lzo",
        f"{root}basebackups_004/{s}",
    ])


def random_inventory(seed, prefixes=3, keys=400):
    rng = random.Random(seed)
    seen = set()
    for p in range(prefixes):
        # The first prefix holds most of the keys.
        for _ in range(keys if p == 0 else keys // 5):
            seen.add((p, random_key(rng, f"db{p}/")))
    return [(p, f"bucket{p % 2}", k, len(k), f"db{p}/", n) for n, (p, k) in enumerate(sorted(seen))]


INVENTORY = "prefix_id bigint, bucket string, key string, size bigint, path_prefix string, n bigint"


def horizon(inventory, prefix, keep):
    backups = sorted(
        (sn for p, _, k, _, root, _ in inventory if p == prefix for t, sn in [classify(root, k) or (None, None)] if t == "sentinel"),
        reverse=True,
    )
    return backups[min(keep, len(backups)) - 1] if backups else None


def deleted(inventory, keep):
    out = set()
    for p, _, k, _, root, _ in inventory:
        c = classify(root, k)
        h = horizon(inventory, p, keep)
        if c and c[1] and h and c[1] < h:
            out.add((p, k))
    return out


def next_fit(sizes, max_bytes, max_members):
    volume = held = members = 0
    out = []
    for s in sizes:
        if held + s >= max_bytes or members >= max_members:
            volume, held, members = volume + 1, s, 1
        else:
            held, members = held + s, members + 1
        out.append(volume)
    return out


def runs(positions):
    out = []
    for p in sorted(set(positions)):
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(r) for r in out]
