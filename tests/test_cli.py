import pytest

from mercato.__main__ import main


@pytest.mark.parametrize("argv", [["sales", "--initial", "2024-03-01"], ["archive"], ["stock"], ["items"], ["refresh", "--keep", "0"], ["nope"]])
def test_arguments_are_checked_before_spark_starts(argv):
    with pytest.raises(SystemExit) as err:
        main(argv)
    assert err.value.code == 2
