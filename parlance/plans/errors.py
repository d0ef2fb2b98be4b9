"""Error types."""


class ParlanceError(Exception):
    """Base of all errors of this package."""


class PipelineConfigError(ParlanceError):
    pass


class PluginRegistrationError(ParlanceError):
    pass


class StepExecutionError(ParlanceError):
    pass


class SchemaValidationError(ParlanceError):
    pass


class AdapterError(ParlanceError):
    pass
