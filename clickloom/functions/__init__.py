from clickloom.functions.expr import *  # noqa: F401,F403
from clickloom.functions.hashing import hash_int, hash_unit  # noqa: F401
