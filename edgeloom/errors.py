"""Two kinds of failure: bad input by the user, and trouble in the environment."""


class UserError(ValueError):
    """The request itself is wrong: a bad pattern, an undefined layer, an empty message."""


class TechnicalError(RuntimeError):
    """The request is fine but could not be carried out."""
