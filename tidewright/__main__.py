"""python -m tidewright: see tidewright.commands."""

from tidewright.commands import main

if __name__ == "__main__":
    main()
