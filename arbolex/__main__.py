import sys

from arbolex.cli import main

sys.exit(main(sys.argv[1:]))
