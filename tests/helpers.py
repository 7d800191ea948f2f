from pathlib import Path

DATA = Path(__file__).parent / "data"


def path(name: str) -> str:
    return str(DATA / name)


def body(lines) -> list[str]:
    return [x for x in lines if not x.startswith("#")]
