"""Values of the catalog's domain: musical keys, certification levels, credit roles, track and video kinds, stream estimates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from crategraph.functions.parse import flexible_date

# Fixed values, from here to the functions.
NOTES = {"C": 0, "C#": 1, "DB": 1, "D": 2, "D#": 3, "EB": 3, "E": 4, "F": 5, "F#": 6, "GB": 6, "G": 7, "G#": 8, "AB": 8, "A": 9, "A#": 10, "BB": 10, "B": 11, "DO": 0, "DO#": 1, "REB": 1, "RE": 2, "RE#": 3, "MIB": 3, "MI": 4, "FA": 5, "FA#": 6, "SOLB": 6, "SOL": 7, "SOL#": 8, "LAB": 8, "LA": 9, "LA#": 10, "SIB": 10, "SI": 11}
MODES = {"major": 1, "majeur": 1, "maj": 1, "1": 1, "minor": 0, "mineur": 0, "min": 0, "0": 0}
FRENCH_NOTES = ("Do", "Do#/Réb", "Ré", "Ré#/Mib", "Mi", "Fa", "Fa#/Solb", "Sol", "Sol#/Lab", "La", "La#/Sib", "Si")
LEVELS = ("Or", "Double Or", "Triple Or", "Platine", "Double Platine", "Triple Platine", "Diamant", "Double Diamant", "Triple Diamant", "Quadruple Diamant", "Gold", "Platinum", "Diamond")
LEVEL_RANKS = {"quadruple diamant": 1, "triple diamant": 2, "double diamant": 3, "diamant": 4, "triple platine": 5, "double platine": 6, "platine": 7, "triple or": 8, "double or": 9, "or": 10, "diamond": 4, "platinum": 7, "gold": 10}
THRESHOLDS = {("Singles", "Or"): 15_000_000, ("Singles", "Platine"): 30_000_000, ("Singles", "Diamant"): 50_000_000, ("Albums", "Or"): 50_000, ("Albums", "Double Or"): 100_000, ("Albums", "Platine"): 100_000, ("Albums", "Double Platine"): 200_000, ("Albums", "Triple Platine"): 300_000, ("Albums", "Diamant"): 500_000}
CATEGORIES = {"SINGLES": "Singles", "SINGLE": "Singles", "ALBUMS": "Albums", "VIDÉOS": "Vidéos", "VIDEOS": "Vidéos", "DVD": "DVD"}
COUNTRIES = {"SNEP": "FR", "BRMA": "BE", "RIAA": "US"}
COUNTRY_RANKS = {"FR": 0, "BE": 1, "US": 2}
SOURCE_RANKS = {"reccobeats": 3, "getsongbpm": 2, "songbpm": 1, "deezer": 0}
ROLES = ("Writer", "Composer", "Lyricist", "Translator", "Producer", "Co-Producer", "Executive Producer", "Vocal Producer", "Additional Production", "Programmer", "Drum Programmer", "Arranger", "Mixing Engineer", "Mastering Engineer", "Recording Engineer", "Engineer", "Assistant Mixing Engineer", "Assistant Mastering Engineer", "Assistant Recording Engineer", "Assistant Engineer", "Studio Personnel", "Additional Mixing", "Additional Mastering", "Additional Recording", "Additional Engineering", "Preparer", "Vocals", "Lead Vocals", "Background Vocals", "Additional Vocals", "Choir", "Ad-Libs", "Label", "Publisher", "Distributor", "Copyright ©", "Phonographic Copyright ℗", "Manufacturer", "Guitar", "Bass Guitar", "Acoustic Guitar", "Electric Guitar", "Rhythm Guitar", "Cello", "Drums", "Bass", "Keyboard", "Percussion", "Piano", "Violin", "Organ", "Synthesizer", "Strings", "Trumpet", "Viola", "Saxophone", "Trombone", "Scratches", "Instrumentation", "Recorded At", "Mastered At", "Mixed At", "Artwork", "Art Direction", "Graphic Design", "Illustration", "Layout", "Photography", "Video Director", "Video Producer", "Video Director of Photography", "Video Cinematographer", "Video Digital Imaging Technician", "Video Camera Operator", "Video Drone Operator", "Video Set Decorator", "Video Editor", "Video Colorist", "A&R", "Featured Artist", "Sample", "Interpolation", "Other")
VIDEO_ROLES = ("Video Director", "Video Producer", "Video Director of Photography", "Video Cinematographer", "Video Digital Imaging Technician", "Video Camera Operator", "Video Drone Operator", "Video Set Decorator", "Video Editor", "Video Colorist", "Photography")
VIDEO_WORDS = ("video", "vidéo", "clip", "director", "réalisateur", "cinematographer", "camera", "caméra", "drone", "steadicam", "gimbal", "electrician", "électricien", "lighting", "éclairage", "gaffer", "grip", "focus puller", "makeup artist", "maquilleur", "maquilleuse", "hair", "coiffeur", "costume", "wardrobe", "styliste", "styling", "editor", "monteur", "monteuse", "colorist", "étalonnage", "motion graphics", "vfx", "visual effects", "effets visuels", "set decorator", "décorateur", "props", "accessoires", "location", "repérage", "casting director", "video producer", "production manager", "assistant director", "script supervisor", "continuity")
MUSIC_WORDS = ("songwriter", "composer", "producer", "mix", "master", "guitar", "piano", "drums", "bass", "vocal", "engineer")
SHOWS = ("grünt", "grunt", "colors show", "a colors show", "planète rap", "planete rap", "oklm", "rentre dans le cercle", "red bull 64 bars", "on the radar", "from the block", "cypher", "freestyle", "radio session")
REMIXES = ("remix", "rmx", "rework", "edit", "bootleg", "vip", "flip", "refix", "version", "mix")
LIVES = ("live", "concert", "tour", "session", "unplugged", "acoustic", "stripped", "intimate")
EXOTICS = ("unreleased", "leaked", "demo", "snippet", "instrumental", "acapella", "radio rip", "bootleg", "edit", "vip", "exclusive", "rare", "vault", "outtake", "alternate")
AUDIO_MARKS = ("(audio)", "audio officiel", "official audio", "[audio]")
CLIP_MARKS = ("clip officiel", "official video", "official music video", "(clip)")
AUTO_SELECT = {"album": True, "single": True, "remix": True, "live": False, "acoustic": True, "exotic": False}
CONFIDENCE = {"album": 0.85, "single": 0.80, "remix": 0.75, "live": 0.70, "acoustic": 0.80, "exotic": 0.60}
SPOTIFY_SHARE, YTM_SHARE = 0.40, 0.25


def lookup(table: dict, key: Column) -> Column:
    """Value of a small fixed table; null where the key is none of it."""
    return F.try_element_at(F.create_map(*(F.lit(x) for x in chain.from_iterable(table.items()))), key)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def pitch_class(note: Column) -> Column:
    """0 to 11 of an English or French note, of 'X/Y' by X, of a number, of a note with a minor m at its end; else null."""
    token = F.upper(F.translate(F.trim(note.cast("string")), "♯♭éèêÉÈ", "#beeeEE"))
    number = F.when(token.rlike(r"^\d+$"), token.try_cast("int"))
    name = F.trim(F.split_part(token, F.lit("/"), F.lit(1)))
    cut = F.when(name.endswith("M"), F.substring(name, F.lit(1), F.length(name) - 1))
    value = F.coalesce(lookup(NOTES, name), lookup(NOTES, cut))
    return F.when(number.isNotNull(), F.when(number.between(0, 11), number)).otherwise(value)


def mode_number(mode: Column) -> Column:
    return lookup(MODES, F.lower(F.trim(mode.cast("string"))))


def french_key(pitch: Column, mode: Column) -> Column:
    """'Ré mineur', 'Do#/Réb majeur'; null unless both are known."""
    names = F.array(*(F.lit(n) for n in FRENCH_NOTES))
    note = F.coalesce(F.get(names, pitch.cast("int")), F.lit("Inconnu"))
    return F.when(pitch.isNotNull() & mode.isNotNull(), F.concat(note, F.when(mode == 1, " majeur").otherwise(" mineur")))


def split_key(key: Column) -> Column:
    """struct<pitch, mode> of 'Si mineur', 'G♯/A♭ majeur', 'A minor'."""
    tokens = F.split(F.trim(key), r"\s+")
    note = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), " ")
    pitch, mode = pitch_class(note), mode_number(F.element_at(tokens, -1))
    ok = (F.size(tokens) >= 2) & pitch.isNotNull() & mode.isNotNull()
    return F.when(ok, F.struct(pitch.alias("pitch"), mode.alias("mode")))


def normalize_key(key: Column) -> Column:
    s = split_key(key)
    return french_key(s["pitch"], s["mode"])


def total_estimate(spotify: Column, ytm: Column) -> Column:
    """All platforms' streams from those of one or both, by market shares; values of 0 or less are missing."""
    sp, yt = (F.when(c > 0, c) for c in (spotify, ytm))
    return (
        F.when(sp.isNotNull() & yt.isNotNull(), (sp + yt).cast("double") / (SPOTIFY_SHARE + YTM_SHARE))
        .when(sp.isNotNull(), sp.cast("double") / SPOTIFY_SHARE)
        .when(yt.isNotNull(), yt.cast("double") / YTM_SHARE)
        .cast("bigint")
    )


def estimate_label(spotify: Column, ytm: Column) -> Column:
    sp, yt = (F.coalesce(c > 0, F.lit(False)) for c in (spotify, ytm))
    return F.when(sp & ~yt, " ~Sp").when(yt & ~sp, " ~YT").otherwise("")


def thousands(n: Column, suffix: str = "") -> Column:
    """'15 734 892' with a suffix; '' for null."""
    return F.when(n.isNull(), "").otherwise(F.concat(F.translate(F.format_number(n, 0), ",", " "), F.lit(suffix)))


def level_name(text: Column) -> Column:
    """Canonical certification level; null if unknown."""
    return lookup({x.upper(): x for x in LEVELS}, F.translate(F.upper(F.trim(text)), "_", " "))


def category_name(text: Column) -> Column:
    return F.coalesce(lookup(CATEGORIES, F.upper(F.trim(text))), F.lit("Singles"))


def category_class(text: Column) -> Column:
    """'single', 'album' or 'video' of a category in either number; others in lower case."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    kinds = {"singles": "single", "single": "single", "albums": "album", "album": "album", "vidéos": "video", "videos": "video", "vidéo": "video", "video": "video"}
    return F.coalesce(lookup(kinds, low), low)


def level_rank(level: Column) -> Column:
    """Display rank, small is high: 'Nx level' ranks 0.1 above its plain level for each multiple up to ten; unknown 99."""
    low = F.lower(F.trim(F.coalesce(level, F.lit(""))))
    pattern = r"^(\d+)\s*x\s+(platine|platinum|or|gold|diamant|diamond)"
    times = F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("int")
    base = lookup({"platine": 7, "platinum": 7, "or": 10, "gold": 10, "diamant": 4, "diamond": 4}, F.regexp_extract(low, pattern, 2))
    return F.coalesce(lookup(LEVEL_RANKS, low).cast("double"), base - F.least(times - 1, F.lit(9)) * 0.1, F.lit(99.0))


def threshold(level: Column, category: Column) -> Column:
    """Units a French certification stands for; 0 if none is set."""
    return F.coalesce(lookup({f"{c}/{v}": n for (c, v), n in THRESHOLDS.items()}, F.concat_ws("/", category, level)), F.lit(0))


def plain_us_level(level: Column) -> Column:
    """'4x Multi-Platinum' to '4x Platinum', 'Multi-Platinum' to 'Platinum'; others stay."""
    level = F.trim(F.coalesce(level, F.lit("")))
    times = F.regexp_extract(level, r"(?i)^(\d+)\s*x\s*multi-?platinum", 1)
    return F.when(times != "", F.concat(times, F.lit("x Platinum"))).when(level.rlike(r"(?i)^multi-?platinum$"), "Platinum").otherwise(level)


def country_rank(country: Column) -> Column:
    return F.coalesce(lookup(COUNTRY_RANKS, country), F.lit(9))


def source_rank(source: Column) -> Column:
    return F.coalesce(lookup(SOURCE_RANKS, source), F.lit(0))


def role_name(role: Column) -> Column:
    """Canonical role of a credit line's label: a known role in any case, its plural too; else Other."""
    low = F.lower(F.trim(role))
    table = {r.lower(): r for r in ROLES}
    return F.coalesce(lookup(table, low), lookup(table, F.regexp_replace(low, "s$", "")), lookup(table, F.regexp_replace(low, "ers\\b", "er")), F.lit("Other"))


def role_detail(role: Column) -> Column:
    """The label itself where ``role_name`` is Other."""
    return F.when(role_name(role) == "Other", F.trim(role))


def is_video_credit(role: Column, detail: Column) -> Column:
    """A film crew's credit: one of the video roles, or Other with a detail that sounds of film and not of music."""
    low = F.lower(F.coalesce(detail, F.lit("")))
    return F.coalesce(role.isin(*VIDEO_ROLES) | ((role == "Other") & any_of(low, VIDEO_WORDS) & ~any_of(low, MUSIC_WORDS)), F.lit(False))


def is_show(title: Column, album: Column) -> Column:
    return any_of(F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(album, F.lit("")))), SHOWS)


def track_kind(title: Column, album: Column, year: Column) -> Column:
    """exotic, remix, acoustic, live, single or album; shows come first, then remixes, live takes, exotic marks, old years."""
    low = F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(is_show(title, album), "exotic")
        .when(any_of(low, REMIXES), "remix")
        .when(any_of(low, LIVES), F.when(any_of(low, ("acoustic", "unplugged")), "acoustic").otherwise("live"))
        .when(any_of(low, EXOTICS) | ((year > 0) & (year < 1990)), "exotic")
        .when(F.coalesce(F.lower(album), F.lit("")).isin("", "single", "ep", "maxi"), "single")
        .otherwise("album")
    )


def video_kind(title: Column, channel: Column) -> Column:
    """audio, show, clip or unknown."""
    low = F.lower(F.coalesce(title, F.lit("")))
    topic = F.trim(F.lower(F.coalesce(channel, F.lit("")))).endswith("- topic")
    return F.when(topic | any_of(low, AUDIO_MARKS), "audio").when(is_show(title, channel), "show").when(any_of(low, CLIP_MARKS), "clip").otherwise("unknown")


def days_to(release: Column, date: Column) -> Column:
    """Days from release to a date; null if negative or unknown."""
    days = F.datediff(flexible_date(date), flexible_date(release))
    return F.when(days >= 0, days)


def milestones(release: Column, entries: Column) -> Column:
    """array<struct<level, days>> of the plain levels reached, at their earliest dates; ``entries``: array of structs with
    ``certification`` and ``certification_date``."""

    def reached(level: str) -> Column:
        dates = F.transform(F.filter(entries, lambda e: e["certification"] == level), lambda e: flexible_date(e["certification_date"]))
        return F.struct(F.lit(level).alias("level"), F.datediff(F.array_min(dates), flexible_date(release)).alias("days"))

    return F.filter(F.array(*(reached(v) for v in ("Or", "Platine", "Diamant"))), lambda x: F.coalesce(x["days"] >= 0, F.lit(False)))
