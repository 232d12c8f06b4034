"""C# classes of the Unity engine: methods that it calls by name, and hosts that are told only from all parts of a project."""

from __future__ import annotations

# Base types, attributes, callbacks of interfaces, and messages of the engine.
BASES = frozenset("MonoBehaviour ScriptableObject NetworkBehaviour StateMachineBehaviour UIBehaviour".split())
EDITOR_BASES = frozenset("Editor EditorWindow ScriptableWizard".split())
ATTRIBUTES = frozenset("RuntimeInitializeOnLoadMethod InitializeOnLoadMethod InitializeOnLoad MenuItem ContextMenu DidReloadScripts PostProcessBuild PostProcessScene OnOpenAsset".split())
CALLBACKS = {
    "ISerializationCallbackReceiver": ("OnBeforeSerialize", "OnAfterDeserialize"), "IHasCustomMenu": ("AddItemsToMenu",), "IPointerEnterHandler": ("OnPointerEnter",), "IPointerExitHandler": ("OnPointerExit",),
    "IPointerDownHandler": ("OnPointerDown",), "IPointerUpHandler": ("OnPointerUp",), "IPointerClickHandler": ("OnPointerClick",), "IPointerMoveHandler": ("OnPointerMove",), "IInitializePotentialDragHandler": ("OnInitializePotentialDrag",),
    "IBeginDragHandler": ("OnBeginDrag",), "IDragHandler": ("OnDrag",), "IEndDragHandler": ("OnEndDrag",), "IDropHandler": ("OnDrop",), "IScrollHandler": ("OnScroll",), "IUpdateSelectedHandler": ("OnUpdateSelected",),
    "ISelectHandler": ("OnSelect",), "IDeselectHandler": ("OnDeselect",), "IMoveHandler": ("OnMove",), "ISubmitHandler": ("OnSubmit",), "ICancelHandler": ("OnCancel",),
}
MESSAGES = frozenset(
    "Awake Start Update LateUpdate FixedUpdate OnEnable OnDisable OnDestroy OnValidate Reset OnGUI OnApplicationFocus OnApplicationPause OnApplicationQuit OnBecameVisible OnBecameInvisible "
    "OnCollisionEnter OnCollisionStay OnCollisionExit OnCollisionEnter2D OnCollisionStay2D OnCollisionExit2D OnTriggerEnter OnTriggerStay OnTriggerExit OnTriggerEnter2D OnTriggerStay2D OnTriggerExit2D "
    "OnControllerColliderHit OnJointBreak OnJointBreak2D OnParticleCollision OnParticleTrigger OnParticleSystemStopped OnMouseDown OnMouseUp OnMouseUpAsButton OnMouseEnter OnMouseExit OnMouseOver OnMouseDrag "
    "OnPreCull OnPreRender OnPostRender OnRenderImage OnRenderObject OnWillRenderObject OnDrawGizmos OnDrawGizmosSelected OnAnimatorMove OnAnimatorIK OnAudioFilterRead OnTransformChildrenChanged "
    "OnTransformParentChanged OnBeforeTransformParentChanged OnRectTransformDimensionsChange OnCanvasGroupChanged OnStateEnter OnStateExit OnStateUpdate OnStateMove OnStateIK OnStateMachineEnter "
    "OnStateMachineExit OnInspectorGUI OnSceneGUI CreateInspectorGUI CreateGUI OnSelectionChange OnFocus OnLostFocus OnHierarchyChange OnProjectChange OnInspectorUpdate OnWizardCreate OnWizardUpdate "
    "OnWizardOtherButton AddItemsToMenu OnBeforeSerialize OnAfterDeserialize".split()
)


def engine_file(path: str, code: str) -> bool:
    """Whether a file belongs to an engine project, by its folder or by the namespaces that its code names."""
    import re

    return any(path.startswith(f"{d}/") or f"/{d}/" in path for d in ("Assets", "Packages")) or re.search(r"(?<![\w.])(?:global::)?(?:UnityEngine|UnityEditor)\b(?=[.;\s])", code) is not None


def interface_like(name: str) -> bool:
    return len(name) > 1 and name[0] == "I" and name[1].isupper()


def annotate(symbols: list[dict], defs: list[dict], path: str, code: str) -> None:
    """Adds entries, risks and tokens to symbols of a C# file; defs hold their modifiers, annotations and base names."""
    inside, assets = engine_file(path, code), path.startswith("Assets/") or "/Assets/" in path

    def direct(d: dict) -> str | None:
        named = d["base_names"]
        return next((b for b in named if b in BASES), None) or (next((b for b in named if b in EDITOR_BASES), None) if inside else None)

    for s, d in zip(symbols, defs, strict=True):
        if s["kind"] == "class":
            base, named, partial = direct(d), d["base_names"], "partial" in d["mods"]
            tokens = (["partial"] if partial else []) + ([f"base-unity:{base}"] if base else []) + ([f"bases:{','.join(named)}"] if named else [])
            s["unity"] = " ".join(tokens) if tokens else "class"
        attribute = next((a for a in (x.removesuffix("Attribute") for x in d["annotations"]) if a in ATTRIBUTES), None)
        if attribute and inside and not s.get("entry"):
            s["entry"] = f"invoked by the engine: [{attribute}]"
            s["entry_cond"] = None
        owner = s["parent_idx"]
        if s["kind"] != "method" or owner is None or symbols[owner]["kind"] not in ("class", "struct"):
            continue
        host = defs[owner]
        if inside and not s.get("entry") and any(s["name"] in CALLBACKS.get(b, ()) for b in host["base_names"]):
            s["entry"] = "callback of an engine interface"
        if symbols[owner]["kind"] != "class" or "static" in d["mods"]:
            continue
        base = direct(host)
        maybe = base is not None or (assets and host["base_names"] and not interface_like(host["base_names"][0]))
        if ("partial" in host["mods"] or maybe) and base is None and not s.get("entry") and s["name"] in MESSAGES:
            s["unity"] = "msg"
        elif maybe and s["name"] in MESSAGES and not s.get("entry"):
            s["entry"] = "message that the engine calls by name"
        elif maybe and not s.get("entry") and "public" in d["mods"] and s["name"] not in MESSAGES:
            s["framework_risk"] = "a public method of an engine class may be bound in a scene or an animation"
