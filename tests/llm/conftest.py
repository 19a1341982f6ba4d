import pytest

from .data import awkward_documents, write_conversations, write_documents


@pytest.fixture(scope="session")
def awkward(tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    odd = "\\0 </s> <s>[INST] [/INST]<<SYS>> [ROLE]x[/ROLE] [TURN] \\\\1 <</s>"
    write_conversations(folder, [
        (1, 0, "system", "be brief"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", odd), (1, 4, "assistant", None), (1, 5, "user", odd),
        (2, 1, "assistant", "second"), (2, 0, None, "no role"), (2, None, "tool</s>", "no turn"), (3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "user", "tie a"),
        (None, 0, "user", "no id"), (4, 0, "assistant", ""), (5, 0, "user", "x" * 100_000), (5, 1, "assistant", "[TURN" + "é😀" * 5_000 + "<")])
    return write_documents(folder, awkward_documents())


@pytest.fixture(scope="session")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    write_conversations(folder, [])
    return write_documents(folder, [])
