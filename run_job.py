"""Entry script for spark-submit. Only the driver needs the package."""

from portolan.__main__ import main

if __name__ == "__main__":
    main()
