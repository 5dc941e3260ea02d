"""Class scores of a tagger, prompts and adaptive parameters. The models are plug-ins; what follows them is relational."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalyn.config import RULES
from stratalyn.operators.frames import mean_in_order
from stratalyn.operators.vectors import dot, norm

#: Classes counted as biological.
BIOLOGICAL = (
    "Animal", "Domestic animals, pets", "Wild animals", "Bird", "Bird vocalization, bird call, bird song", "Chirp, tweet", "Squawk", "Pigeon, dove", "Crow", "Owl", "Hoot", "Cluck", "Coo", "Caw",
    "Insect", "Cricket", "Mosquito", "Fly, housefly", "Bee, wasp, etc.", "Frog", "Croak", "Whale vocalization", "Roar", "Growling", "Bark", "Howl", "Yip", "Whimper (dog)", "Bow-wow", "Bay", "Meow", "Hiss", "Purr",
    "Bleat", "Neigh, whinny", "Moo", "Cowbell", "Pig", "Oink", "Squeak", "Chicken, rooster", "Crowing, cock-a-doodle-doo", "Turkey", "Gobble", "Duck", "Quack", "Goose", "Honk", "Rodents, rats, mice", "Mouse", "Bat",
)
#: Classes counted as noise.
NOISE = (
    "Vehicle", "Car", "Truck", "Motorcycle", "Engine", "Aircraft", "Wind", "Wind noise (microphone)", "Wind chime", "Rain", "Thunder", "Thunderstorm", "Speech", "Conversation", "Male speech, man speaking",
    "Female speech, woman speaking", "Music", "Singing", "Musical instrument", "Mechanisms", "Machinery", "Industrial", "Silence", "White noise", "Pink noise", "Static",
)
#: Hints in the order in which they are looked for, words in a class name, and how many leading classes count.
HINTS = (
    ("insect_sustained", ("Insect", "Mosquito", "Cricket", "Bee"), 3),
    ("marine_mammal", ("Whale",), 5),
    ("bird_calls", ("Bird", "Chirp", "Tweet"), 3),
    ("amphibian", ("Frog", "Croak"), 3),
    ("wind_dominant", ("Wind",), 3),
)


def _best(scores: Column, names: tuple[str, ...]) -> Column:
    inside = F.filter(scores, lambda x: x["name"].isin(*names))
    return F.coalesce(F.array_max(F.transform(inside, lambda x: x["score"])), F.lit(0.0))


#: Prompts for captions without training.
PROMPTS = (
    "a bird call", "a bird song", "a frog or amphibian call", "an insect call or stridulation", "a mammal vocalization", "a bat echolocation call", "wind or weather noise", "rain", "human speech",
    "engine or vehicle noise", "water flowing", "silence or background hiss", "anthropogenic noise",
)


def prompt_table(spark, embed, prompts: tuple[str, ...] = PROMPTS) -> DataFrame:
    """(prompt, embedding) of literal prompts; ``embed`` is a plug-in that maps texts to vectors."""
    rows = [(p, [float(x) for x in v]) for p, v in zip(prompts, embed(list(prompts)))]
    return spark.createDataFrame(rows, "prompt string, embedding array<double>")


def window_tags(df: DataFrame, scores: str) -> DataFrame:
    """Best biological and best noise score of each window; ``scores`` is an array of (name, score)."""
    return df.withColumn("bio_score", _best(F.col(scores), BIOLOGICAL)).withColumn("noise_score", _best(F.col(scores), NOISE))


def recording_tags(windows: DataFrame, keys: list[str], active: float = 0.30) -> DataFrame:
    """Mean scores of the windows of a recording and the share of windows with biological activity."""
    return windows.groupBy(*keys).agg(F.avg("bio_score").alias("mean_bio"), F.avg("noise_score").alias("mean_noise"), F.avg((F.col("bio_score") > active).cast("int")).alias("bio_fraction"), F.count("*").alias("n_windows"))


def top_classes(df: DataFrame, keys: list[str], scores: str, k: int, order: str | None = None) -> DataFrame:
    """The ``k`` classes of the largest mean score, as an ordered array of (name, score).

    ``order`` is a column by which scores are summed: means then have the same last bits, and equal ones the same order,
    however the rows are dealt.
    """
    each = df.select(*keys, F.explode(scores).alias("x"), *([F.col(order).alias("_o")] if order else []))
    mean = mean_in_order(F.col("x.score"), F.col("_o")) if order else F.avg("x.score")
    each = each.groupBy(*keys, F.col("x.name").alias("name")).agg(mean.alias("score"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "name", "score")))
    return each.groupBy(*keys).agg(F.transform(F.slice(ordered, 1, k), lambda x: F.struct(x["name"].alias("name"), x["score"].alias("score"))).alias("top"))


def hint(top: Column, bio: Column, noise: Column) -> Column:
    """The first hint with one of its words in a leading class, else which mean score is larger; no class: unknown."""
    def named(words: tuple[str, ...], depth: int) -> Column:
        return F.exists(F.slice(top, 1, depth), lambda x: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x["name"], w)))

    found = F.coalesce(*[F.when(named(words, depth), name) for name, words, depth in HINTS], F.when(bio > noise, "general_animal").otherwise("background_dominant"))
    return F.when(F.coalesce(F.size(top), F.lit(0)) < 1, "unknown").otherwise(found)


def caption(clips: DataFrame, prompts: DataFrame, keys: list[str], vector: str, order: str, most: int = 4) -> DataFrame:
    """The prompt most similar to the mean of a group's first clips; prompts are (prompt, embedding).

    Both sides may be large: the plan broadcasts one only if it is small, else it compares them in blocks, and each task
    passes on no more than its best prompt of a group.
    """
    from stratalyn.operators.vectors import centroids, ranked

    first = ranked(clips.withColumn("_o", -F.col(order)), keys, "_o", order, most)
    mean = centroids(first, keys, vector)
    p = prompts.select("prompt", F.col("embedding").alias("_p"))
    sim = F.round(dot(F.col("centroid"), F.col("_p")) / norm(F.col("_p")), 7)
    best = mean.crossJoin(p).withColumn("_s", sim).groupBy(*keys).agg(F.max(F.struct("_s", "prompt")).alias("b"))
    return best.select(*keys, F.col("b.prompt").alias("prompt"), F.col("b._s").alias("similarity"))


def adaptive(profile: DataFrame, dynamic: str, tonal: str, regime: str, semantic: str | None = None) -> DataFrame:
    """Parameters of each recording as columns: the rules of ``config.RULES`` in order, later ones over earlier ones.

    A parameter that no rule sets is null: the setting of the run holds.
    """
    given = {"dynamic_range": dynamic, "median_tonality": tonal, "regime": regime, "hint": semantic}
    out: dict[str, Column] = {}
    for what, low, high, changes in RULES:
        if given[what] is None:
            continue
        c = F.col(given[what])
        test = (c == low) if isinstance(low, str) else (c >= low) & (c < high)
        for name, value in changes.items():
            out[name] = F.when(test, F.lit(value)).otherwise(out.get(name, F.lit(None)))
    return profile.withColumns(out)
