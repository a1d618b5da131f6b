import random
import time

from conftest import rows
from trackspan.operators.chat import last_n_turns
from trackspan.streaming.memory import TURNS, ChatMemory


def arrive(spark, memory, folder, checkpoint, turns):
    spark.createDataFrame(turns, TURNS).write.mode("append").parquet(folder)
    memory.keep(spark.readStream.schema(TURNS).parquet(folder), checkpoint, period=None).awaitTermination()


def test_windows_equal_the_batch_result_at_every_step(spark, tmp_path):
    rnd, folder = random.Random(1), str(tmp_path / "in")
    memory = ChatMemory(spark, str(tmp_path / "m"), n=3, every=2)
    turns = [(c, t, rnd.choice(["user", None]), rnd.choice([f"x{t}", None])) for c in range(8) for t in range(rnd.randint(1, 9))]
    turns += [(100, t, "user", "hot") for t in range(400)]
    rnd.shuffle(turns)
    for i in range(3):
        arrive(spark, memory, folder, str(tmp_path / "cp"), turns[i::3] + [(None, 1, "user", "x"), (5, None, "user", "x")])
        arrived = spark.read.schema(TURNS).parquet(folder).where("conv_id IS NOT NULL AND turn IS NOT NULL")
        assert rows(memory.current()) == rows(last_n_turns(arrived, 3))
    assert memory.current(0).count() < memory.current().count() + 8


def test_silent_conversations_expire(spark, tmp_path):
    memory = ChatMemory(spark, str(tmp_path / "m"), n=3, expire_ms=1000)
    args = str(tmp_path / "in"), str(tmp_path / "cp")
    arrive(spark, memory, *args, [(1, 1, "user", "a"), (2, 1, "user", "b")])
    assert rows(memory.current(), "conv_id") == [(1,), (2,)]
    time.sleep(1.5)
    arrive(spark, memory, *args, [(2, 2, "user", "c")])
    # The one that spoke again keeps its turns; the other is dropped, and starts empty when it returns.
    assert rows(memory.current(), "conv_id", "turn") == [(2, 1), (2, 2)]
    arrive(spark, memory, *args, [(1, 7, "user", "d")])
    assert (1, 7) in rows(memory.current(), "conv_id", "turn") and (1, 1) not in rows(memory.current(), "conv_id", "turn")
